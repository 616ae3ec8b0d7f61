"""Search, mention, vector and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import identity as I
from tessera.functions.lineage import stored
from tessera.operators import extraction as E
from tessera.operators import languages
from tessera.operators import search as S
from tessera.plans.registry import query

ENTRIES = "SELECT 'part' AS kind, p_partkey AS id, p_name AS label, p_name AS value, true AS is_title FROM part UNION ALL SELECT 'part', p_partkey, p_name, p_type || ' ' || p_brand, false FROM part UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT), n_name, n_name, true FROM nation UNION ALL SELECT 'customer', c_custkey, c_name, c_name, true FROM customer UNION ALL SELECT 'customer', c_custkey, c_name, c_mktsegment, false FROM customer"


def _entries(t):
    row = lambda df, kind, id_, label, value, title: df.select(F.lit(kind).alias("kind"), F.col(id_).cast("long").alias("id"), F.col(label).alias("label"), value.alias("value"), F.lit(title).alias("is_title"))
    parts = [
        row(t.part, "part", "p_partkey", "p_name", F.col("p_name"), True), row(t.part, "part", "p_partkey", "p_name", F.concat_ws(" ", "p_type", "p_brand"), False),
        row(t.nation, "nation", "n_nationkey", "n_name", F.col("n_name"), True), row(t.customer, "customer", "c_custkey", "c_name", F.col("c_name"), True),
        row(t.customer, "customer", "c_custkey", "c_name", F.col("c_mktsegment"), False),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


RANKED = f"""h AS (SELECT *, CASE WHEN is_title AND starts_with(lower(value), 'ma') THEN 0 WHEN is_title THEN 1 ELSE 3 END AS rank FROM ({ENTRIES}) e WHERE position('ma' IN lower(value)) > 0),
    r AS (SELECT kind, id, label, rank, value FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY rank, length(value), value) AS n FROM h) x WHERE n = 1)"""


@query("search_flat", f"WITH {RANKED} SELECT * FROM r ORDER BY rank, length(label), label, id LIMIT 50")
def search_flat(t):
    return S.flat(_entries(t), "ma", 50)


@query(
    "search_groups",
    f"""WITH {RANKED}, k AS (SELECT kind, CAST(row_number() OVER (ORDER BY min(rank), count(*) DESC, kind) AS INTEGER) AS place FROM r GROUP BY kind)
    SELECT x.*, k.place FROM (SELECT *, count(*) OVER (PARTITION BY kind) AS total, min(rank) OVER (PARTITION BY kind) AS best, CAST(row_number() OVER (PARTITION BY kind ORDER BY rank, length(label), label, id) AS INTEGER) AS rn FROM r) x JOIN k ON k.kind = x.kind WHERE rn <= 5""",
)
def search_groups(t):
    return S.grouped(_entries(t), "ma", 5)


@query(
    "search_catalogue",
    """WITH c AS (SELECT DISTINCT kind AS name, replace(kind, '_', ' ') AS word, first_label AS definition FROM (SELECT kind, min(label) AS first_label FROM node GROUP BY kind) x)
    SELECT name, word, CAST(CASE WHEN lower(word) = 'part' THEN 0 WHEN starts_with(lower(word), 'part') THEN 1 WHEN position('part' IN lower(word)) > 0 THEN 2 ELSE 3 END AS INTEGER) AS rank,
      CASE WHEN position('part' IN lower(word)) > 0 THEN word ELSE definition END AS matched FROM c WHERE position('part' IN lower(word)) > 0 OR position('part' IN lower(coalesce(definition, ''))) > 0""",
)
def search_catalogue(t):
    kinds = t.node.groupBy(F.col("kind").alias("name")).agg(F.min("label").alias("definition")).withColumn("word", F.translate("name", "_", " "))
    return S.catalogue_ranked(kinds, " PART ")


TITLE = "lower(regexp_extract(html, '<title>([^<]+)</title>', 1))"


@query(
    "term_mentions",
    """WITH w AS (SELECT DISTINCT w[1] AS one, w[2] AS two FROM (SELECT regexp_extract_all(lower(regexp_extract(html, '<title>([^<]+)</title>', 1)), '[\\p{L}\\p{N}_$]+') AS w FROM pages) x WHERE len(w) > 1 AND w[1] <> w[2]),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
    t AS (SELECT doc_id, line, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, line, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_$]+|[^\\p{L}\\p{N}_$]+') AS t FROM l) x),
    p AS (SELECT doc_id, line, token, lead(token) OVER v AS gap, lead(token, 2) OVER v AS after FROM t WINDOW v AS (PARTITION BY doc_id, line ORDER BY i)),
    first AS (SELECT doc_id, regexp_extract(lower(string_split(text, chr(10))[1]), '^[\\p{L}\\p{N}_$]+') AS term FROM documents),
    m AS (SELECT doc_id, line, token AS term FROM p WHERE token IN (SELECT two FROM w) UNION ALL SELECT doc_id, line, one || ' ' || two FROM p JOIN w ON w.one = token AND gap = ' ' AND w.two = after)
    SELECT doc_id, CAST(line AS INTEGER) AS line, term, count(*) AS n FROM m WHERE NOT (line = 1 AND (doc_id, term) IN (SELECT doc_id, term FROM first)) GROUP BY 1, 2, 3""",
)
def term_mentions(t):
    """Words of page titles as terms: the second, also under the name of both together, and both together as a term of its own.
    The first line of a document defines its first word."""
    words = F.expr(f"regexp_extract_all({TITLE}, '[\\\\p{{L}}\\\\p{{N}}_$]+', 0)")
    title = t.pages.select(words.alias("w")).where((F.size("w") > 1) & (F.try_element_at("w", F.lit(1)) != F.try_element_at("w", F.lit(2)))).select(F.col("w")[0].alias("one"), F.col("w")[1].alias("two"))
    both = F.concat_ws(" ", "one", "two")
    names = F.array(*[F.struct(a.alias("term"), b.alias("name")) for a, b in ((F.col("two"), F.col("two")), (F.col("two"), both), (both, both))])
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    first = docs.select("id", F.regexp_extract(F.lower(F.substring_index("text", "\n", 1)), r"^[\p{L}\p{N}_$]+", 0).alias("term"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"))
    return S.term_mentions(docs, title.select(F.inline(names)), first).withColumnRenamed("id", "doc_id")


INDEX = [
    ("name", "small bolt", "Bolt"), ("name", "red gear", "Gear A"), ("name", "red gear", "Gear B"), ("extension", ".ts", "TypeScript"), ("extension", ".ts", "XML"), ("extension", ".md", "Markdown"),
    ("extension", ".md", "GCC Machine Description"), ("extension", ".sql", "PLSQL"), ("extension", ".sql", "TSQL"), ("extension", ".py", "Python"), ("extension", ".in", "Template"), ("extension", ".py.in", "Python Template"), ("interpreter", "python", "Python"), ("interpreter", "node", "JavaScript"), ("interpreter", "node", "TypeScript"),
]
CONTENT = """CASE file % 5 WHEN 0 THEN '#!/usr/bin/env -S python3.12 -u' || chr(10) || bytes WHEN 1 THEN '{"bytes": ' || bytes || '}' WHEN 2 THEN 'x' || chr(10) || '  (define_insn' WHEN 3 THEN '#! /opt/node' ELSE 'GO' END"""
PATH = "CASE file % 4 WHEN 1 THEN regexp_replace(path, '[.][a-z]+$', '') WHEN 2 THEN upper(path) || '.in' ELSE path END"


@query(
    "path_language",
    f"""WITH i(kind, key, language) AS (VALUES {", ".join(map(str, INDEX))}), f AS (SELECT file, lower(regexp_extract({PATH}, '[^/]*$')) AS name, {CONTENT} AS content FROM file),
    e AS (SELECT file, name, content, substr(name, strpos(name, '.')) AS a, CASE WHEN strpos(name, '.') > 0 THEN regexp_extract(name, '[.][^.]*$') END AS b FROM f),
    c AS (SELECT e.*, (SELECT list(language ORDER BY language) FROM i WHERE kind = 'name' AND key = e.name) AS n, (SELECT list(language ORDER BY language) FROM i WHERE kind = 'extension' AND key = e.a) AS x, (SELECT list(language ORDER BY language) FROM i WHERE kind = 'extension' AND key = e.b) AS y FROM e),
    d AS (SELECT *, coalesce(n, x, y) AS held, CASE WHEN n IS NOT NULL THEN name WHEN x IS NOT NULL THEN a WHEN y IS NOT NULL THEN b END AS how FROM c),
    s AS (SELECT *, CASE WHEN how = '.md' AND content LIKE '%(define_insn%' THEN 'GCC Machine Description' WHEN how = '.sql' AND content = 'GO' THEN 'TSQL' WHEN how = '.ts' THEN 'TypeScript' WHEN how = '.md' THEN 'Markdown' WHEN how = '.sql' THEN 'SQL' END AS chosen,
      CASE WHEN content LIKE '#!/usr%' THEN 'Python' WHEN content LIKE '#! /opt%' THEN 'JavaScript' WHEN content LIKE '{{%' THEN 'JSON' ELSE 'unknown' END AS other FROM d)
    SELECT file, CASE WHEN held IS NULL THEN other WHEN len(held) = 1 THEN held[1] WHEN list_contains(held, chosen) THEN chosen ELSE 'ambiguous' END AS language, array_to_string(coalesce(held, [other]), ',') AS candidates FROM s""",
)
def path_language(t):
    """Languages of the files' paths under an index of a few: some without their extension, some templates, with contents that
    name an interpreter, are JSON or decide between candidates."""
    files = t.file.select("file", F.expr(PATH).alias("path"), F.expr(CONTENT.replace("chr(10) || bytes", "chr(10) || string(bytes)").replace("' || bytes || '", "' || string(bytes) || '")).alias("content"))
    index = t.spark.createDataFrame(INDEX, "kind string, key string, language string")
    return languages.language_of_paths(files, index).select("file", "language", F.array_join("candidates", ",").alias("candidates"))


@query("line_range", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT doc_id, CAST(line AS BIGINT) AS line, text FROM l WHERE line BETWEEN 2 AND 3")
def line_range(t):
    return S.line_range(t.documents, 2, 3)


@query(
    "glossary_definitions",
    """WITH d AS (SELECT page_id, 1 AS n, trim(regexp_extract(html, '<title>([^<]+)</title>', 1), ' ') AS term, url AS definition FROM pages UNION ALL SELECT page_id, 2, 'page ' || CAST(page_id AS VARCHAR), regexp_extract(html, '<html lang="([a-z]+)"', 1) FROM pages)
    SELECT page_id, CAST(n AS INTEGER) AS n, term, definition FROM d WHERE term <> '' AND term NOT LIKE '%*%' AND definition <> ''""",
)
def glossary_definitions(t):
    """A page's title and number as terms of a Markdown text; titles with asterisks aren't terms in bold."""
    bold = lambda term, said: F.concat(F.lit("**"), term, F.lit("** — "), said)
    title, lang = F.regexp_extract("html", "<title>([^<]+)</title>", 1), F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    text = F.concat_ws("\n", bold(title, F.col("url")), F.concat(F.lit("- "), bold(F.concat(F.lit("page "), F.col("page_id").cast("string")), lang)), F.lit("no **term** here"))
    rows = S.glossary(t.pages.select("page_id", text.alias("text")), "page_id")
    return rows.select("page_id", F.when(F.startswith("term", F.lit("page ")), 2).otherwise(1).alias("n"), "term", "definition")


def _vector(metric, expr):
    sql = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT q.vec_id AS query_id, e.vec_id, round({expr}, 6) AS distance FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
      SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) x WHERE rank <= 10"""

    @query(f"vector_{metric}", sql)
    def run(t):
        return S.exact_neighbours(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), metric, 10)

    return run


_vector("l2", "list_distance(q.v, e.v)")
_vector("cosine", "1 - list_inner_product(q.v, e.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(e.v, e.v)))")
_vector("inner_product", "-list_inner_product(q.v, e.v)")


@query(
    "vector_scoped",
    """WITH v AS (SELECT 's' || CAST(vec_id % 5 AS VARCHAR) AS source, CASE WHEN vec_id % 3 = 0 THEN 'wide' ELSE 'narrow' END AS space, vec_id // 5 AS item, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
      d AS (SELECT q.space, q.vec_id AS query_id, e.source, e.item, round(list_distance(q.v, e.v), 6) AS distance FROM v q JOIN v e ON e.space = q.space WHERE q.vec_id % 20 = 0 AND e.source IN ('s1', 's2', 's4'))
      SELECT space, query_id, CAST(rank AS INTEGER) AS rank, source, item, distance FROM (SELECT *, row_number() OVER (PARTITION BY space, query_id ORDER BY distance, source, item) AS rank FROM d) x WHERE rank <= 5""",
)
def vector_scoped(t):
    """Every twentieth vector against the vectors of three of five sources, each in its own space."""
    source, space = F.concat(F.lit("s"), (F.col("vec_id") % 5).cast("string")), F.when(F.col("vec_id") % 3 == 0, "wide").otherwise("narrow")
    v = t.embeddings.select(source.alias("source"), space.alias("space"), F.expr("vec_id div 5").alias("item"), "vec_id", "embedding")
    asked = v.where("vec_id % 20 = 0").select("space", F.col("vec_id").alias("query_id"), "embedding")
    return S.scoped_neighbours(v, asked, ["s1", "s2", "s4"], "l2", 5)


@query("canonical_key", "SELECT id, '{\"kind\":\"' || kind || '\",\"key\":' || CASE WHEN removed THEN 'null' ELSE '\"' || nkey || '\"' END || '}' AS key, sha256('{\"kind\":\"' || kind || '\",\"key\":' || CASE WHEN removed THEN 'null' ELSE '\"' || nkey || '\"' END || '}') AS digest FROM node")
def canonical_key(t):
    key = I.canonical_key([("kind", F.col("kind")), ("key", F.when(~F.col("removed"), F.col("nkey")))])
    return t.node.select("id", key.alias("key")).withColumn("digest", F.sha2("key", 256))


@query("node_uid", "WITH h AS (SELECT id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(kind) || unhex('00') || encode('[\"' || nkey || '\"]')) AS h FROM node) SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uid FROM node JOIN h USING (id)")
def node_uid(t):
    return t.node.select("id", I.name_uid(F.col("kind"), F.concat(F.lit('["'), "nkey", F.lit('"]'))).alias("uid"))


@query(
    "search_line",
    r"""WITH d AS (SELECT doc_id, text AS value, CASE WHEN lang = 'en' THEN sha256(text) ELSE source END AS label FROM documents),
    l AS (SELECT doc_id, value, label, CASE WHEN regexp_full_match(label, '[0-9a-f]{7,64}') THEN substr(label, 1, 7) ELSE label END AS short, regexp_replace(regexp_replace(split_part(value, chr(10), 1), '^\s+', ''), '\s+$', '') AS line FROM d)
    SELECT doc_id, CASE WHEN value = '' OR value = label THEN short ELSE short || ' — ' || CASE WHEN length(line) > 90 THEN regexp_replace(substr(line, 1, 90), '\s+\S*$', '') || '…' ELSE line END END AS line FROM l""",
)
def search_line(t):
    label = F.when(F.col("lang") == "en", F.sha2("text", 256)).otherwise(F.col("source"))
    return t.documents.select("doc_id", I.search_line(label, F.col("text")).alias("line"))


@query("redaction", "SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 3 END AS INTEGER) AS kept, CASE WHEN event_id % 3 <> 0 THEN event_type END AS value FROM event")
def redaction(t):
    name = F.when(F.col("event_id") % 3 == 0, "API-Key").otherwise("colour")
    context = F.create_map(F.lit("unit"), F.col("event_type"), F.lit("auth_Token"), F.col("event_type"), name, F.col("event_type"), F.lit("run"), F.col("event_type"))
    safe = I.redacted(context, ["token", "secret", "password", "apikey"])
    return t.event.select("event_id", F.size(safe).alias("kept"), F.try_element_at(safe, F.lit("colour")).alias("value"))


@query("clock_parts", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M') AS local, CAST(floor((1735689600000 - epoch_us(ts) // 1000) / 86400000.0) AS BIGINT) AS age_days FROM events")
def clock_parts(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format(ts + F.expr("INTERVAL 90 MINUTE"), "yyyy-MM-dd HH:mm").alias("local"),
        F.floor((F.lit(1_735_689_600_000) - F.unix_millis(ts.cast("timestamp"))) / F.lit(86_400_000.0)).alias("age_days"),
    )


@query("json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_fields(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("type_names", "SELECT DISTINCT o_orderpriority AS name, array_to_string(list_transform(list_filter(regexp_split_to_array(o_orderpriority, '[^A-Za-z0-9]+'), lambda p: p <> ''), lambda p: upper(substr(p, 1, 1)) || lower(substr(p, 2))), '') AS pascal FROM orders")
def type_names(t):
    return t.orders.select(F.col("o_orderpriority").alias("name")).distinct().withColumn("pascal", I.pascal(F.col("name")))


#: What the page plugin declares; scripts, and the number of advertisements, it does not.
PAGES = E.Contract(
    {"page": {"lang": E.Field("text", True), "words": E.Field("integer")}, "path": {}},
    {"links": (["page"], ["path"], {"place": E.Field("integer")}), "loads": (["page"], ["path"], {})},
)


def read_page(row):
    """A page and its links; of pages with signs in their title also what breaks the contract."""
    import re

    title = re.search("<title>([^<]*)</title>", row.html)[1]
    extra = {"ads": row.html.count('class="ad"')} if "*" in title else {}
    lang = re.search('<html lang="([a-z]+)"', row.html)
    page = ("page", str(row.page_id))
    yield E.vertex(*page, lang=lang and lang[1] if "$" not in title else None, words="many" if "#" in title else title.count(" ") + 1, **extra)
    for path in dict.fromkeys(re.findall('<a href="(/[^"]*)">', row.html)):
        yield E.vertex("path", path)
        yield E.edge("links", page, ("path", path))
    if "track(" in row.html:
        yield E.vertex("script", "track")
        yield E.edge("loads", page, ("script", "track"))
    yield E.edge("links", page, ("path", "nowhere"))


@query(
    "plugin_refusals",
    """WITH p AS (SELECT page_id AS unit, CAST(page_id AS VARCHAR) AS id, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
    l AS (SELECT DISTINCT unit, id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)">', 1)) AS path FROM p), bad AS (SELECT unit, id FROM p WHERE title LIKE '%*%' OR title LIKE '%#%' OR title LIKE '%$%')
    SELECT unit, 'vertex' AS what, 'page' AS kind, id, 'undeclared-field' AS rule, 'ads' AS name FROM p WHERE title LIKE '%*%' UNION ALL SELECT unit, 'vertex', 'page', id, 'wrong-type', 'words' FROM p WHERE title LIKE '%#%'
    UNION ALL SELECT unit, 'vertex', 'page', id, 'missing-field', 'lang' FROM p WHERE title LIKE '%$%' UNION ALL SELECT unit, 'vertex', 'script', 'track', 'undeclared-kind', NULL FROM p WHERE html LIKE '%track(%'
    UNION ALL SELECT unit, 'edge', 'loads', id || '>track', 'end-not-allowed', 'to' FROM p WHERE html LIKE '%track(%' UNION ALL SELECT unit, 'edge', 'loads', id || '>track', 'end-missing', 'from' FROM p WHERE html LIKE '%track(%' AND unit IN (SELECT unit FROM bad)
    UNION ALL SELECT unit, 'edge', 'links', id || '>nowhere', 'end-missing', 'to' FROM p UNION ALL SELECT unit, 'edge', 'links', id || '>nowhere', 'end-missing', 'from' FROM bad UNION ALL SELECT b.unit, 'edge', 'links', b.id || '>' || path, 'end-missing', 'from' FROM bad b JOIN l ON l.unit = b.unit""",
)
def plugin_refusals(t):
    """What the page plugin answers against its contract, for every page."""
    found = stored(E.answers(t.pages.select("page_id", "html"), "page_id", read_page))
    return E.judged(found, PAGES)[1]
