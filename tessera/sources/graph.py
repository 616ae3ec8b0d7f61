"""Graph, opinion, assertion and span relations derived from the star-schema tables.

Each relation is one SQL text that Spark and other SQL engines read alike: ``{table}`` names a base table, ``MS(x)`` the
epoch milliseconds of a timestamp. Relations refer to earlier relations by name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.lineage import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

RELATIONS = {
    "node": """
        SELECT 'region' AS kind, 1000000000000 + r_regionkey AS id, r_name AS label, CAST(r_regionkey AS STRING) AS nkey, false AS removed FROM {region}
        UNION ALL SELECT 'nation', 2000000000000 + n_nationkey, n_name, CAST(n_nationkey AS STRING), false FROM {nation}
        UNION ALL SELECT 'customer', 3000000000000 + c_custkey, c_name, CAST(c_custkey AS STRING), c_custkey % 97 = 96 FROM {customer}
        UNION ALL SELECT 'supplier', 4000000000000 + s_suppkey, s_name, CAST(s_suppkey AS STRING), s_suppkey % 89 = 88 FROM {supplier}
        UNION ALL SELECT 'part', 5000000000000 + p_partkey, p_name, CAST(p_partkey AS STRING), p_partkey % 101 = 100 FROM {part}
        UNION ALL SELECT 'order', 6000000000000 + o_orderkey, o_orderpriority, CAST(o_orderkey AS STRING), false FROM {orders}""",
    "edge": """
        SELECT 'in_region' AS rel, 2000000000000 + n_nationkey AS src, 1000000000000 + n_regionkey AS dst, CAST(1 AS BIGINT) AS weight FROM {nation}
        UNION ALL SELECT 'in_nation', 3000000000000 + c_custkey, 2000000000000 + c_nationkey, CAST(1 AS BIGINT) FROM {customer}
        UNION ALL SELECT 'in_nation', 4000000000000 + s_suppkey, 2000000000000 + s_nationkey, CAST(1 AS BIGINT) FROM {supplier}
        UNION ALL SELECT 'placed', 3000000000000 + o_custkey, 6000000000000 + o_orderkey, CAST(1 AS BIGINT) FROM {orders}
        UNION ALL SELECT 'touched', 6000000000000 + l_orderkey, 5000000000000 + l_partkey, CAST(sum(l_quantity) AS BIGINT) FROM {lineitem} GROUP BY l_orderkey, l_partkey
        UNION ALL SELECT 'supplied_by', 6000000000000 + l_orderkey, 4000000000000 + l_suppkey, count(*) FROM {lineitem} GROUP BY l_orderkey, l_suppkey""",
    "event": """
        SELECT event_id, MS(ts) AS tick, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM {events}""",
    "opinion": """
        SELECT event_id AS id, user_id * 20 + k % 20 AS holder, event_type AS producer, event_type || '@' || CAST(event_id % 4 AS STRING) AS said_by, tick AS said_at,
            CASE event_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS lang,
            'g' || CAST(CAST(FLOOR(k / 20) AS BIGINT) % 3 AS STRING) AS grade,
            CASE WHEN event_id % 6 <> 5 THEN CAST(FLOOR(k / 20) AS BIGINT) END AS amount,
            CASE WHEN event_id % 7 <> 6 THEN 'title ' || CAST(k % 50 AS STRING) END AS title,
            CASE WHEN event_id % 4 <> 0 THEN 'file' || CAST(event_id % 50 AS STRING) || ':' || CAST(k + 1 AS STRING) END AS evidence,
            CASE row_number() OVER (PARTITION BY user_id * 20 + k % 20, event_type ORDER BY event_id DESC) WHEN 1 THEN 'open' WHEN 2 THEN 'confirmed' ELSE 'closed' END AS state
        FROM event""",
    "assertion": """
        SELECT CASE WHEN event_id % 5 = 0 THEN 'src2' ELSE 'src1' END AS source, 'user' AS kind, user_id AS entity_id, event_type AS content, tick AS valid_from,
            lead(tick) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_to,
            tick + (event_id % 7) * 3600000 AS recorded_from,
            CASE WHEN event_id % 9 = 0 THEN tick + CAST(2592000000 AS BIGINT) + (event_id % 7) * 3600000 END AS recorded_to,
            'c' || CAST(event_id AS STRING) AS opened_by, lead('c' || CAST(event_id AS STRING)) OVER (PARTITION BY user_id ORDER BY event_id) AS closed_by
        FROM event""",
    "span": """
        SELECT event_id AS span, CASE WHEN event_id % 10 <> 0 THEN event_id - event_id % 10 + CAST(FLOOR((event_id % 10) / 3) AS BIGINT) END AS parent,
            CAST(FLOOR(event_id / 100) AS BIGINT) AS trace, event_type AS name,
            (event_id % 10) * 40 + CAST(FLOOR(event_id / 10) AS BIGINT) * 500 + k % 10 AS started,
            (event_id % 10) * 40 + CAST(FLOOR(event_id / 10) AS BIGINT) * 500 + k % 10 + CASE WHEN event_id % 10 = 0 THEN 380 ELSE 20 + k END AS ended,
            k AS memory, event_id % 11 = 0 AS failed
        FROM event""",
    "usage": """
        SELECT event_id AS seq, user_id AS session, CAST(user_id % 12 AS BIGINT) AS run, event_type AS kind, 'm' || CAST(k % 3 AS STRING) AS model,
            sum(1 + k) OVER (PARTITION BY user_id, reset ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reading, tick, CASE WHEN k % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CAST(k AS BIGINT) AS cost
        FROM (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reset FROM event) e""",
    "log": """
        SELECT event_id AS id, CASE WHEN event_id % 13 <> 0 THEN tick END AS tick, CASE event_id % 4 WHEN 0 THEN 'debug' WHEN 1 THEN 'info' WHEN 2 THEN 'warn' ELSE 'error' END AS level,
            event_type AS source, user_id AS run, CASE WHEN k % 5 = 0 THEN 'src/f' || CAST(k AS STRING) || '.ts:' || CAST(event_id % 300 AS STRING) || ': failed' WHEN k % 5 = 1 THEN 'unit ' || CAST(k AS STRING) || ' started' ELSE 'step done' END AS message
        FROM event""",
    "held": """
        SELECT 'ordered_by' AS rel, 6000000000000 + o_orderkey AS src, 3000000000000 + o_custkey AS dst, MS(o_orderdate) AS valid_from, MS(o_orderdate) + CAST(FLOOR(o_totalprice) AS BIGINT) * 100000 AS valid_to FROM {orders}
        UNION ALL SELECT 'shipped_for', 4000000000000 + l_suppkey, 6000000000000 + l_orderkey, MS(l_shipdate), CAST(NULL AS BIGINT) FROM {lineitem}""",
    "renamed": """
        SELECT src, dst FROM (SELECT p_partkey AS src, lag(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey) AS dst FROM {part}) r WHERE dst IS NOT NULL""",
    "file": """
        SELECT p_partkey AS file, p_brand || '/' || p_type || '/' || p_name || '.' || CASE p_size % 4 WHEN 0 THEN 'sql' WHEN 1 THEN 'ts' WHEN 2 THEN 'md' ELSE 'py' END AS path,
            p_brand AS repository, CAST(p_size AS BIGINT) * 40 AS lines, CAST(FLOOR(p_retailprice) AS BIGINT) AS bytes FROM {part}""",
    "change": """
        SELECT l_partkey AS file, l_orderkey AS commit_id, MS(l_shipdate) AS tick, l_returnflag AS flag, CAST(l_quantity AS BIGINT) AS added, CAST(l_linenumber AS BIGINT) AS removed, l_suppkey AS author FROM {lineitem}""",
    # histories of 500 commits a repository; every tenth commit merges a side branch of two, and dates don't follow ancestry
    "commit": """
        SELECT CAST(FLOOR(o_orderkey / 500) AS BIGINT) AS repository, o_orderkey AS commit_id, MS(o_orderdate) AS committed_at, o_orderkey % 500 AS position, 499 - o_orderkey % 500 AS walk, o_custkey AS author FROM {orders}""",
    "parent": """
        SELECT o_orderkey AS commit_id, 0 AS place, CASE WHEN o_orderkey % 10 = 9 THEN o_orderkey - 3 ELSE o_orderkey - 1 END AS parent FROM {orders} WHERE o_orderkey % 500 > 0
        UNION ALL SELECT o_orderkey, 1, o_orderkey - 1 FROM {orders} WHERE o_orderkey % 10 = 9""",
}

#: What a relation groups in groups as many as rows: the table, a key that all of its groupings hold, and the rows of a task.
GROUPED = {"edge": ("lineitem", "l_orderkey", 500_000)}


def spark_text(text: str) -> str:
    return re.sub(r"\bMS\((\w+)\)", r"unix_millis(CAST(\1 AS TIMESTAMP))", text)


def oracle_text(text: str) -> str:
    return re.sub(r"\bMS\((\w+)\)", r"(epoch_us(\1) // 1000)", text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation as a lazy DataFrame; Catalyst prunes and pushes through it.

    A large table that it groups is dealt by the key over as many tasks as its rows ask for, so that the groups of one task, and
    what is done with them there, stay of a size. The rows are counted from the files' footers.
    """
    text = RELATIONS[name]
    inputs = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    if name in GROUPED:
        grouped, key, rows = GROUPED[name]
        inputs[grouped] = spread(inputs[grouped], -(-inputs[grouped].count() // rows), key)
    text = spark_text(text)
    for other in RELATIONS:
        if re.search(rf"\bFROM {other}\b", text):
            text = re.sub(rf"\bFROM {other}\b", f"FROM {{{other}}}", text)
            inputs[other] = relation(spark, sf_dir, other)
    return spark.sql(text, **inputs)


def with_relations(sql: str) -> str:
    """The query with the relations it needs as common table expressions over the base tables."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in RELATIONS.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need(body)
                if name not in needed:
                    needed.append(name)

    need(sql)
    plain = {t: t for t in TABLES}
    ctes = ", ".join(f"{n} AS ({oracle_text(RELATIONS[n]).format(**plain)})" for n in needed)
    if not ctes:
        return sql
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if head:
        return f"WITH {head[1] or ''}{ctes}, {sql[head.end():]}"
    return f"WITH {ctes} {sql}"
