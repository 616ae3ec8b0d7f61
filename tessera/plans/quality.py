"""Rules, checks and problem reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.operators import quality as Q
from tessera.operators import rules as R
from tessera.plans.registry import query


@query("condition_property", "SELECT id FROM node WHERE kind = 'supplier' AND label LIKE '%7'")
def condition_property(t):
    return Q.matching(t.node, t.edge, {"all": [{"property": ("kind", "_eq", "supplier")}, {"property": ("label", "_like", "%7")}]})


@query("condition_algebra", """WITH big AS (SELECT e.src AS id FROM edge e WHERE e.rel = 'placed' AND e.dst IN (SELECT id FROM node WHERE label = '1-URGENT') GROUP BY e.src HAVING count(*) >= 2)
    SELECT id FROM node WHERE kind = 'customer' AND id IN (SELECT id FROM big) AND NOT removed UNION SELECT id FROM node WHERE kind = 'supplier' AND id NOT IN (SELECT dst FROM edge WHERE rel = 'supplied_by' GROUP BY dst HAVING count(*) >= 150)""")
def condition_algebra(t):
    urgent = {"neighbours": {"rel": "placed", "side": "out", "atLeast": 2, "where": {"property": ("label", "_eq", "1-URGENT")}}}
    busy = {"neighbours": {"rel": "supplied_by", "side": "in", "atLeast": 150}}
    c = {"any": [
        {"all": [{"property": ("kind", "_eq", "customer")}, urgent, {"not": {"property": ("removed", "_eq", True)}}]},
        {"all": [{"property": ("kind", "_eq", "supplier")}, {"not": busy}]},
    ]}
    return Q.matching(t.node, t.edge, c)


@query("node_check", "SELECT p_partkey AS id, CASE WHEN p_name = '' THEN 'required' WHEN p_retailprice <> floor(p_retailprice) THEN 'whole-number' WHEN p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'one-of' WHEN NOT starts_with(p_brand, 'Brand#') THEN 'record-key' WHEN p_size > 40 THEN 'span' END AS failure FROM part")
def node_check(t):
    checks = [
        ("required", F.col("p_name") == ""), ("whole-number", F.col("p_retailprice") != F.floor("p_retailprice")), ("one-of", ~F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO")),
        ("record-key", ~F.startswith("p_brand", F.lit("Brand#"))), ("span", F.col("p_size") > 40),
    ]
    return t.part.select(F.col("p_partkey").alias("id"), Q.first_failure(checks).alias("failure"))


@query("edge_check", "SELECT e.rel, e.src, e.dst, CASE WHEN a.id IS NULL THEN 'from-missing' WHEN b.id IS NULL THEN 'to-missing' WHEN e.rel = 'touched' AND b.kind <> 'part' THEN 'to-kind' WHEN e.weight < 2 AND e.rel = 'touched' THEN 'weight' END AS failure FROM edge e LEFT JOIN node a ON a.id = e.src LEFT JOIN node b ON b.id = e.dst")
def edge_check(t):
    a = t.node.select(F.col("id").alias("src"), F.col("kind").alias("a"))
    b = t.node.select(F.col("id").alias("dst"), F.col("kind").alias("b"))
    rows = t.edge.join(a, "src", "left").join(b, "dst", "left")
    touched = F.col("rel") == "touched"
    checks = [("from-missing", F.col("a").isNull()), ("to-missing", F.col("b").isNull()), ("to-kind", touched & (F.col("b") != "part")), ("weight", touched & (F.col("weight") < 2))]
    return rows.select("rel", "src", "dst", Q.first_failure(checks).alias("failure"))


@query("rule_large_file", "SELECT file, lines FROM file WHERE lines >= 1900")
def rule_large_file(t):
    return t.file.where("lines >= 1900").select("file", "lines")


@query("rule_change_hotspot", "SELECT f.file, f.lines * c.n AS heat FROM file f JOIN (SELECT file, count(DISTINCT commit_id) AS n FROM change GROUP BY file) c ON c.file = f.file WHERE f.lines * c.n >= 60000")
def rule_change_hotspot(t):
    n = t.change.groupBy("file").agg(F.count_distinct("commit_id").alias("n"))
    return t.file.join(n, "file").select("file", (F.col("lines") * F.col("n")).alias("heat")).where("heat >= 60000")


@query("rule_dead_export", "SELECT file FROM file WHERE file NOT IN (SELECT file FROM change WHERE flag = 'A')")
def rule_dead_export(t):
    return Q.not_in(t.file.select("file"), t.change.where("flag = 'A'"), "file")


@query("rule_debt_marker", "SELECT doc_id, len(regexp_extract_all(text, '[%$&*#]{3}')) AS markers FROM documents WHERE regexp_matches(text, '[%$&*#]{3}')")
def rule_debt_marker(t):
    mark = "[%$&*#]{3}"
    return t.documents.where(F.col("text").rlike(mark)).select("doc_id", F.regexp_count("text", F.lit(mark)).cast("long").alias("markers"))


@query("rule_development_value", "SELECT doc_id, regexp_extract(text, '(password|token)[=:] *([A-Za-z0-9]+)', 2) AS value FROM documents WHERE regexp_matches(text, '(password|token)[=:] *([A-Za-z0-9]+)')")
def rule_development_value(t):
    p = "(password|token)[=:] *([A-Za-z0-9]+)"
    return t.documents.where(F.col("text").rlike(p)).select("doc_id", F.regexp_extract("text", p, 2).alias("value"))


@query("rule_declared_unused", "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R')")
def rule_declared_unused(t):
    used = t.lineitem.where("l_quantity >= 50 AND l_returnflag = 'R'").select(F.col("l_suppkey").alias("id"))
    return Q.not_in(t.supplier.select(F.col("s_suppkey").alias("id")), used, "id")


@query("rule_used_undeclared", "SELECT DISTINCT holder AS id FROM opinion WHERE state = 'open' AND holder NOT IN (SELECT c_custkey FROM customer)")
def rule_used_undeclared(t):
    return Q.not_in(t.opinion.where("state = 'open'").select(F.col("holder").alias("id")).distinct(), t.customer.select(F.col("c_custkey").alias("id")), "id")


@query("rule_operation_without_route", "SELECT DISTINCT 'operation-without-route' AS rule, CAST(user_id AS VARCHAR) AS target, '' AS detail FROM event WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM event WHERE event_type = 'signup' AND k > 70)")
def rule_operation_without_route(t):
    signed = t.event.where("event_type = 'signup' AND k > 70").select(F.col("user_id").alias("key"))
    return R.without("operation-without-route", t.event.where("event_type = 'purchase'").select(F.col("user_id").alias("key")), signed)


@query("rule_route_without_operation", "SELECT DISTINCT 'route-without-operation' AS rule, CAST(user_id AS VARCHAR) AS target, '' AS detail FROM event WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM event WHERE event_type = 'purchase' AND k < 10)")
def rule_route_without_operation(t):
    bought = t.event.where("event_type = 'purchase' AND k < 10").select(F.col("user_id").alias("key"))
    return R.without("route-without-operation", t.event.where("event_type = 'signup'").select(F.col("user_id").alias("key")), bought)


@query(
    "rule_route_outside_group",
    """WITH r AS (SELECT o_orderkey AS key, o_orderstatus AS service, o_orderpriority AS root, o_totalprice > 400000 AS inside, c_acctbal < 0 AS public FROM orders JOIN customer ON c_custkey = o_custkey), g AS (SELECT DISTINCT service, root FROM r WHERE inside)
    SELECT 'route-outside-group' AS rule, CAST(key AS VARCHAR) AS target, CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.service = r.service AND g.root = r.root) THEN 'group ' || root ELSE 'contract' END AS detail
    FROM r WHERE NOT inside AND service IN (SELECT service FROM g) AND (NOT public OR EXISTS (SELECT 1 FROM g WHERE g.service = r.service AND g.root = r.root))""",
)
def rule_route_outside_group(t):
    return R.routes_outside(*_routes(t))


def _routes(t):
    """Orders as routes of a service, by status; the dear ones are in its group. They serve their customers, public if in debt."""
    o = t.orders
    routes = o.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("service"), F.concat(F.lit("/"), "o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_totalprice") > 400_000).alias("inside"))
    serves = o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("c_custkey")).join(t.customer.select("c_custkey", (F.col("c_acctbal") < 0).alias("public")), "c_custkey").select("key", "public")
    return routes, serves


IMPORTS = "SELECT p_partkey AS a, CASE WHEN p_partkey % 10 < 3 THEN p_partkey - p_partkey % 10 + (p_partkey % 10 + 1) % 3 ELSE p_partkey - 1 END AS b FROM part"


@query("rule_dependency_cycle", f"WITH d AS ({IMPORTS}), r AS (SELECT a - a % 10 AS ring, a FROM d WHERE a % 10 < 3) SELECT 'dependency-cycle' AS rule, CAST(ring AS VARCHAR) AS target, string_agg(CAST(a AS VARCHAR), ',' ORDER BY a) AS detail FROM r GROUP BY ring HAVING count(*) = 3")
def rule_dependency_cycle(t):
    k = F.col("p_partkey")
    return R.dependency_cycles(t.part.select(k.alias("src"), F.when(k % 10 < 3, k - k % 10 + (k % 10 + 1) % 3).otherwise(k - 1).alias("dst")))


@query(
    "rule_sql_input",
    """SELECT DISTINCT 'sql-input' AS rule, CAST(l_suppkey AS VARCHAR) AS target, CAST(l_orderkey AS VARCHAR) AS detail FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING')""",
)
def rule_sql_input(t):
    """Customers of a segment as inputs, their orders as builders, the suppliers of returned lines as sinks."""
    flow = lambda df, a, src, b, dst: df.select(F.lit(a).alias("src_kind"), F.col(src).alias("src"), F.lit(b).alias("dst_kind"), F.col(dst).alias("dst"))
    inputs = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    into = flow(t.orders.join(inputs, "o_custkey", "left_semi"), "input", "o_custkey", "build", "o_orderkey")
    return R.sql_inputs(into.unionByName(flow(t.lineitem.where("l_returnflag = 'R'"), "build", "l_orderkey", "sink", "l_suppkey")))


@query(
    "rules_judged",
    """SELECT 'large-file' AS rule, CAST(file AS VARCHAR) AS target, CAST(lines AS VARCHAR) AS detail FROM file WHERE lines >= 1960
    UNION SELECT 'change-hotspot', CAST(f.file AS VARCHAR), CAST(f.lines * c.n AS VARCHAR) FROM file f JOIN (SELECT file, count(DISTINCT commit_id) AS n FROM change GROUP BY file) c ON c.file = f.file WHERE f.lines * c.n >= 60000
    UNION SELECT 'dead-export', CAST(file AS VARCHAR), '' FROM file WHERE file NOT IN (SELECT file FROM change WHERE flag = 'A')
    UNION SELECT 'declared-unused', CAST(s_suppkey AS VARCHAR), '' FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50)
    UNION SELECT 'used-undeclared', CAST(holder AS VARCHAR), '' FROM opinion WHERE state = 'open' AND holder NOT IN (SELECT c_custkey FROM customer)""",
)
def rules_judged(t):
    key = lambda df, c: df.select(F.col(c).cast("long").alias("key"))
    rules = {
        "large-file": lambda s: R.large_files(t.file, **s), "change-hotspot": lambda s: R.hotspots(t.file, t.change, **s),
        "dead-export": lambda s: R.without("dead-export", key(t.file, "file"), key(t.change.where("flag = 'A'"), "file")),
        "declared-unused": lambda s: R.without("declared-unused", key(t.supplier, "s_suppkey"), key(t.lineitem.where("l_quantity >= 50"), "l_suppkey")),
        "used-undeclared": lambda s: R.without("used-undeclared", key(t.opinion.where("state = 'open'"), "holder"), key(t.customer, "c_custkey")),
        "debt-marker": lambda s: R.debt_markers(t.documents, **s),
    }
    return R.judged(rules, {"large-file": {"lines": 1_960}, "debt-marker": {"on": False}})


@query(
    "rule_taint_path",
    "SELECT DISTINCT a.src AS input, b.dst AS sink FROM edge a JOIN edge b ON b.src = a.dst WHERE a.rel = 'placed' AND b.rel = 'supplied_by' AND a.src IN (SELECT 3000000000000 + c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND b.dst IN (SELECT 4000000000000 + s_suppkey FROM supplier WHERE s_acctbal < 0)",
)
def rule_taint_path(t):
    """Paths of two hops from inputs (customers of a segment) to sinks (suppliers in debt)."""
    inputs = t.customer.where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") + 3_000_000_000_000).alias("input"))
    sinks = t.supplier.where("s_acctbal < 0").select((F.col("s_suppkey") + 4_000_000_000_000).alias("sink"))
    return Q.paths_between(t.edge.where("rel IN ('placed', 'supplied_by')").select("src", "dst"), inputs, sinks, 2)


FOUND = """f AS (SELECT DISTINCT * FROM (SELECT 'large-file' AS rule, CAST(file AS VARCHAR) AS target, '' AS detail FROM file WHERE lines >= 1800 UNION ALL SELECT 'dead-export', CAST(file AS VARCHAR), '' FROM file WHERE file NOT IN (SELECT file FROM change WHERE flag = 'A')
    UNION ALL SELECT 'removed-line', CAST(file AS VARCHAR), flag FROM change WHERE removed >= 7) x WHERE (rule, target) NOT IN (SELECT 'large-file', CAST(p_partkey AS VARCHAR) FROM part WHERE p_type = 'PROMO'))"""


def _found(t):
    parts = [
        Q.findings("large-file", t.file.where("lines >= 1800"), "file"), Q.findings("dead-export", Q.not_in(t.file, t.change.where("flag = 'A'"), "file"), "file"),
        Q.findings("removed-line", t.change.where("removed >= 7"), "file", F.col("flag")),
    ]
    dismissed = t.part.where("p_type = 'PROMO'").select(F.lit("large-file").alias("rule"), F.col("p_partkey").cast("string").alias("target"))
    return Q.without_dismissed(reduce(lambda a, b: a.unionByName(b), parts), dismissed)


@query("findings", f"WITH {FOUND} SELECT rule, target, detail FROM f")
def findings(t):
    return _found(t)


@query("problem_categories", f"WITH {FOUND} SELECT rule, count(*) AS n, count(*) FILTER (WHERE CAST(target AS BIGINT) % 2 = 0) AS closed, count(*) FILTER (WHERE CAST(target AS BIGINT) % 2 <> 0) AS open FROM f GROUP BY rule")
def problem_categories(t):
    even = F.col("target").cast("long") % 2 == 0
    return _found(t).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(even, 1)).alias("closed"), F.count(F.when(~even, 1)).alias("open"))


@query("problem_order", f"WITH {FOUND} SELECT rule, target, detail FROM f ORDER BY CAST(target AS BIGINT) % 2, CASE rule WHEN 'dead-export' THEN 0 WHEN 'large-file' THEN 1 ELSE 2 END, target, detail LIMIT 100")
def problem_order(t):
    rank = F.when(F.col("rule") == "dead-export", 0).when(F.col("rule") == "large-file", 1).otherwise(2)
    return _found(t).orderBy(F.col("target").cast("long") % 2, rank, "target", "detail").limit(100)


@query("verdict_report", "SELECT role, kind, count(*) AS total, count(*) FILTER (WHERE k < 60) AS valid, count(*) FILTER (WHERE k >= 60 AND k < 80) AS invalid, count(*) FILTER (WHERE k >= 80) AS unreviewed FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'node' ELSE 'edge' END AS role, event_type AS kind, k FROM event) x GROUP BY GROUPING SETS ((role, kind), (role), ())")
def verdict_report(t):
    k = F.col("k")
    rows = t.event.select(F.when(F.col("user_id") % 2 == 0, "node").otherwise("edge").alias("role"), F.col("event_type").alias("kind"), "k")
    return rows.groupingSets([["role", "kind"], ["role"], []], "role", "kind").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(k < 60, 1)).alias("valid"), F.count(F.when((k >= 60) & (k < 80), 1)).alias("invalid"), F.count(F.when(k >= 80, 1)).alias("unreviewed")
    )


@query("verdict_reasons", "SELECT event_type AS reason, count(*) AS n FROM event WHERE k >= 60 GROUP BY 1 ORDER BY n DESC, reason LIMIT 10")
def verdict_reasons(t):
    return t.event.where("k >= 60").groupBy(F.col("event_type").alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(10)


@query(
    "unit_validation",
    """SELECT id, refused FROM (SELECT o_orderkey AS id, concat_ws(',', CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'kind' END, CASE WHEN o_orderstatus = 'F' AND o_totalprice < 100000 THEN 'missing:price' END, CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'extra:note' END,
      CASE WHEN c.c_custkey IS NULL THEN 'reference' END) AS refused FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey AND c.c_acctbal >= 0) x WHERE refused <> ''""",
)
def unit_validation(t):
    price = F.when((F.col("o_orderstatus") != "F") | (F.col("o_totalprice") >= 100_000), F.map_from_arrays(F.array(F.lit("price")), F.array(F.lit("1"))))
    note = F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"), F.map_from_arrays(F.array(F.lit("note")), F.array(F.lit("x"))))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    key = F.map_concat(F.map_from_arrays(F.array(F.lit("number")), F.array(F.col("o_orderkey").cast("string"))), F.coalesce(price, none), F.coalesce(note, none))
    units = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), key.alias("key"), F.col("o_custkey").alias("ref"))
    return Q.validated(units, {"O": ("number", "price"), "F": ("number", "price")}, t.customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("ref")))
