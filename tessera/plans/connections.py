"""Scans, filters, ordering, pages and connections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import connections as C
from tessera.operators import predicates as P
from tessera.plans.registry import query

#: Orders with a field that is null for a third of the rows.
ORD = "SELECT o_orderkey AS id, o_orderpriority AS priority, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS price FROM orders"


def _orders(t):
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderkey") % 4 != 0, F.floor("o_totalprice")).alias("price"),
    )


def _where(name, clauses, sql):
    @query(name, f"WITH r AS ({ORD}) SELECT * FROM r WHERE {sql}")
    def run(t):
        return P.where(_orders(t), clauses)

    return run


_where("where_eq", {"status": {"_eq": "O"}}, "status IS NOT DISTINCT FROM 'O'")
_where("where_eq_null", {"status": {"_eq": None}}, "status IS NULL")
_where("where_neq", {"status": {"_neq": "O"}}, "status IS DISTINCT FROM 'O'")
_where("where_in", {"priority": {"_in": ["1-URGENT", "2-HIGH"]}}, "priority IN ('1-URGENT', '2-HIGH')")
_where("where_nin", {"status": {"_nin": ["O", "F"]}}, "status NOT IN ('O', 'F')")
_where("where_contains", {"priority": {"_contains": "high"}}, "priority ILIKE '%high%'")
_where("where_like", {"priority": {"_like": "_-L%"}}, "priority LIKE '_-L%'")
_where("where_range", {"price": {"_gte": 100000, "_lt": 250000}, "id": {"_gt": 5}}, "price >= 100000 AND price < 250000 AND id > 5")
_where("where_is_null", {"price": {"_is_null": True}, "status": {"_is_null": False}}, "price IS NULL AND status IS NOT NULL")
_where("where_and", {"status": {"_neq": "P"}, "price": {"_lte": 200000}, "priority": {"_contains": "medium"}}, "status IS DISTINCT FROM 'P' AND price <= 200000 AND priority ILIKE '%medium%'")


def _catalogue(name, clauses, sql):
    @query(name, f"WITH r AS ({ORD}) SELECT * FROM r WHERE {sql}")
    def run(t):
        return P.where(_orders(t), clauses, P.CATALOGUE)

    return run


_catalogue("catalogue_nin", {"status": {"_nin": ["O", "F"]}, "price": {"_in": [None, 150000, 200000]}}, "(status IS NULL OR status NOT IN ('O', 'F')) AND (price IS NULL OR price IN (150000, 200000))")
_catalogue("catalogue_like", {"priority": {"_like": "_-%E%M", "_contains": "-"}, "status": {"_neq": None}}, "priority LIKE '_-%E%M' AND priority LIKE '%-%' AND status IS NOT NULL")
_catalogue("catalogue_compare", {"priority": {"_gt": "2-HIGH", "_lte": "4-NOT SPECIFIED"}, "status": {"_gte": "F"}, "price": {"_lt": 200000}}, "priority > '2-HIGH' AND priority <= '4-NOT SPECIFIED' AND status >= 'F' AND price < 200000")


@query("catalogue_order", f"WITH r AS ({ORD}) SELECT * FROM r ORDER BY status DESC NULLS LAST, price ASC NULLS LAST, id LIMIT 500")
def catalogue_order(t):
    rows = _orders(t)
    return rows.orderBy(*P.catalogue_ordering([("status", "DESC"), ("price", "ASC")], rows, "id")).limit(500)


@query("order_nulls", f"WITH r AS ({ORD}) SELECT * FROM r ORDER BY status DESC NULLS FIRST, price ASC NULLS LAST, id LIMIT 500")
def order_nulls(t):
    return _orders(t).orderBy(*P.ordering([("status", "DESC", "FIRST"), ("price", "ASC", "LAST")], "id")).limit(500)


@query("keyset_page", f"WITH r AS ({ORD}) SELECT * FROM r WHERE price > 150000 OR price IS NULL OR (price = 150000 AND id > 7) ORDER BY price ASC NULLS LAST, id LIMIT 51")
def keyset_page(t):
    return P.page(_orders(t), [("price", "ASC", "LAST")], "id", 50, P.encode_cursor([150000], 7))


@query("keyset_page_null", f"WITH r AS ({ORD}) SELECT * FROM r WHERE status IS NOT NULL OR (status IS NULL AND id > 300) ORDER BY status DESC NULLS FIRST, id LIMIT 31")
def keyset_page_null(t):
    return P.page(_orders(t), [("status", "DESC", "FIRST")], "id", 30, P.encode_cursor([None], 300))


@query(
    "keyset_page_two",
    f"WITH r AS ({ORD}) SELECT * FROM r WHERE (priority < '3-MEDIUM') OR (priority = '3-MEDIUM' AND (price > 200000 OR price IS NULL)) OR (priority = '3-MEDIUM' AND price = 200000 AND id > 10) ORDER BY priority DESC NULLS LAST, price ASC NULLS LAST, id LIMIT 21",
)
def keyset_page_two(t):
    return P.page(_orders(t), [("priority", "DESC", "LAST"), ("price", "ASC", "LAST")], "id", 20, P.encode_cursor(["3-MEDIUM", 200000], 10))


@query("kind_scan", "SELECT id, label FROM node WHERE kind = 'customer' AND NOT removed")
def kind_scan(t):
    return t.node.where("kind = 'customer' AND NOT removed").select("id", "label")


@query("opinion_scan", "SELECT id, holder, grade FROM opinion WHERE state = 'open' AND holder IN (SELECT user_id * 20 FROM event WHERE event_type = 'signup')")
def opinion_scan(t):
    holders = t.event.where("event_type = 'signup'").select((F.col("user_id") * 20).alias("holder"))
    return t.opinion.where("state = 'open'").select("id", "holder", "grade").join(holders, "holder", "left_semi")


@query("edge_scan", "SELECT e.src, e.dst, a.label AS from_label, b.label AS to_label FROM edge e JOIN node a ON a.id = e.src JOIN node b ON b.id = e.dst WHERE e.rel = 'in_nation'")
def edge_scan(t):
    a, b = (t.node.select(F.col("id").alias(k), F.col("label").alias(f"{w}_label")) for k, w in (("src", "from"), ("dst", "to")))
    return t.edge.where("rel = 'in_nation'").select("src", "dst").join(a, "src").join(b, "dst")


@query("lookup_uid", "SELECT kind, id, label FROM node WHERE id = 3000000000042")
def lookup_uid(t):
    return t.node.where("id = 3000000000042").select("kind", "id", "label")


@query("lookup_key", "SELECT n.id, n.kind, n.nkey FROM node n JOIN (SELECT DISTINCT 'part' AS kind, CAST(l_partkey AS VARCHAR) AS nkey FROM lineitem WHERE l_quantity > 49) r ON n.kind = r.kind AND n.nkey = r.nkey")
def lookup_key(t):
    refs = t.lineitem.where("l_quantity > 49").select(F.lit("part").alias("kind"), F.col("l_partkey").cast("string").alias("nkey")).distinct()
    return t.node.select("id", "kind", "nkey").join(refs, ["kind", "nkey"])


@query("files_page", "SELECT file, path, lines FROM file WHERE starts_with(path, 'Brand#1') AND path LIKE '%.ts' AND path > 'Brand#1' ORDER BY path, file LIMIT 26")
def files_page(t):
    rows = t.file.where(F.startswith("path", F.lit("Brand#1")) & F.col("path").like("%.ts")).select("file", "path", "lines")
    return rows.where("path > 'Brand#1'").orderBy("path", "file").limit(26)


@query("prefix_scan", "SELECT id, nkey FROM node WHERE kind = 'order' AND nkey LIKE '12%' AND nkey > '120' ORDER BY nkey, id LIMIT 40")
def prefix_scan(t):
    return t.node.where((F.col("kind") == "order") & F.startswith("nkey", F.lit("12")) & (F.col("nkey") > "120")).select("id", "nkey").orderBy("nkey", "id").limit(40)


@query("substring_key_search", "SELECT id, label FROM node WHERE kind = 'part' AND position(lower('RING') IN lower(label)) > 0")
def substring_key_search(t):
    return t.node.where((F.col("kind") == "part") & (F.instr(F.lower("label"), "ring") > 0)).select("id", "label")


CLASSES = [("**/*.sql", "schema"), ("Brand#1*/**", "vendor"), ("**/ECONOMY/*.md", "docs"), ("**/*.??", "code")]


@query("file_class", "SELECT file, CASE WHEN regexp_matches(path, '^(?:.*/)?[^/]*\\.sql$') THEN 'schema' WHEN regexp_matches(path, '^Brand#1[^/]*/.*$') THEN 'vendor' WHEN regexp_matches(path, '^(?:.*/)?ECONOMY/[^/]*\\.md$') THEN 'docs' WHEN regexp_matches(path, '^(?:.*/)?[^/]*\\.[^/][^/]$') THEN 'code' ELSE 'other' END AS class FROM file")
def file_class(t):
    return t.file.select("file", P.first_match(F.col("path"), CLASSES, "other").alias("class"))


RULES = [("Brand#1", "one"), ("Brand#12", "dozen"), ("Brand#", "any"), ("Brand#2", "two")]


@query("rule_selection", "SELECT repository, CASE WHEN repository = 'Brand#1' THEN 'one' WHEN repository = 'Brand#2' THEN 'two' WHEN starts_with(repository, 'Brand#12') THEN 'dozen' WHEN starts_with(repository, 'Brand#1') THEN 'one' WHEN starts_with(repository, 'Brand#2') THEN 'two' WHEN starts_with(repository, 'Brand#') THEN 'any' ELSE 'none' END AS rule, count(*) AS n FROM file GROUP BY 1, 2")
def rule_selection(t):
    return t.file.groupBy("repository", P.longest_prefix(t.file, "repository", RULES, "none").alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query("relation_connection", "SELECT parent, child, weight, total, rn FROM (SELECT dst AS parent, src AS child, weight, count(*) OVER (PARTITION BY dst) AS total, CAST(row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) AS INTEGER) AS rn FROM edge WHERE rel = 'touched' AND weight > 3) x WHERE rn <= 4")
def relation_connection(t):
    rows = t.edge.where("rel = 'touched' AND weight > 3").select(F.col("dst").alias("parent"), F.col("src").alias("child"), "weight")
    return C.connection(rows, "parent", [F.desc("weight"), F.asc("child")], 3)


@query("reference_inverse", "SELECT n_name AS target, c_custkey AS holder, total, rn FROM (SELECT n.n_name, c.c_custkey, count(*) OVER (PARTITION BY n.n_nationkey) AS total, CAST(row_number() OVER (PARTITION BY n.n_nationkey ORDER BY c.c_custkey) AS INTEGER) AS rn FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey) x WHERE rn <= 6")
def reference_inverse(t):
    rows = t.customer.select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("holder")).join(t.nation.select("n_nationkey", F.col("n_name").alias("target")), "n_nationkey")
    return C.connection(rows, "n_nationkey", [F.asc("holder")], 5).select("target", "holder", "total", "rn")


@query("agreed_reference", """WITH r AS (SELECT l_partkey AS part, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN max(l_suppkey) END AS supplier FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1 GROUP BY l_partkey)
    SELECT r.part, s.s_name AS supplier FROM r JOIN supplier s ON s.s_suppkey = r.supplier""")
def agreed_reference(t):
    from tessera.operators.opinions import agreed

    stated = t.lineitem.where("l_returnflag = 'R' AND l_linenumber = 1").groupBy(F.col("l_partkey").alias("part")).agg(agreed("l_suppkey").alias("s_suppkey"))
    return stated.join(t.supplier, "s_suppkey").select("part", F.col("s_name").alias("supplier"))


@query("page_with_total", "SELECT t.total, p.id FROM (SELECT count(*) AS total FROM node WHERE kind = 'supplier') t LEFT JOIN (SELECT id FROM node WHERE kind = 'supplier' AND id > 4999999999999 ORDER BY id LIMIT 10) p ON true")
def page_with_total(t):
    rows = t.node.where("kind = 'supplier'")
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row: broadcast to the empty page
    return total.join(rows.where("id > 4999999999999").select("id").orderBy("id").limit(10), F.lit(True), "left")


@query("kind_counts", "SELECT kind, count(DISTINCT id) AS n FROM node WHERE NOT removed GROUP BY kind")
def kind_counts(t):
    return t.node.where("NOT removed").groupBy("kind").agg(F.count_distinct("id").alias("n"))


@query("repository_counts", "SELECT (SELECT count(*) FROM file) AS files, (SELECT count(DISTINCT commit_id) FROM change) AS commits, (SELECT count(DISTINCT repository) FROM file) AS directories")
def repository_counts(t):
    files = t.file.agg(F.count(F.lit(1)).alias("files"), F.count_distinct("repository").alias("directories"))
    return files.crossJoin(t.change.agg(F.count_distinct("commit_id").alias("commits")))  # one row each


@query("containment_counts", "SELECT r.r_name AS container, 'nation' AS kind, count(*) AS n FROM nation x JOIN region r ON x.n_regionkey = r.r_regionkey GROUP BY 1 UNION ALL SELECT r.r_name, 'customer', count(*) FROM customer c JOIN nation x ON c.c_nationkey = x.n_nationkey JOIN region r ON x.n_regionkey = r.r_regionkey GROUP BY 1 UNION ALL SELECT r.r_name, 'supplier', count(*) FROM supplier c JOIN nation x ON c.s_nationkey = x.n_nationkey JOIN region r ON x.n_regionkey = r.r_regionkey GROUP BY 1")
def containment_counts(t):
    # counts first: what joins the nations is 25 rows a kind
    per = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("customer"))
    per = per.unionByName(t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("supplier")))
    per = per.unionByName(t.nation.select("n_nationkey", F.lit(1).cast("long").alias("n"), F.lit("nation").alias("kind")))
    joined = per.join(t.nation, "n_nationkey").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(F.col("r_name").alias("container"), "kind").agg(F.sum("n").alias("n"))


@query("path_change_stats", "SELECT file, count(DISTINCT commit_id) AS commits, max(tick) AS last_change, min(tick) AS first_change, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags FROM change GROUP BY file")
def path_change_stats(t):
    return t.change.groupBy("file").agg(
        F.count_distinct("commit_id").alias("commits"), F.max("tick").alias("last_change"), F.min("tick").alias("first_change"), F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("flags")
    )


@query("first_last_commit", "SELECT file, first(commit_id ORDER BY tick, commit_id) AS created_by, first(commit_id ORDER BY tick DESC, commit_id DESC) AS modified_by, count(DISTINCT author) AS authors FROM change GROUP BY file")
def first_last_commit(t):
    key = F.struct("tick", "commit_id")
    return t.change.groupBy("file").agg(F.min(key)["commit_id"].alias("created_by"), F.max(key)["commit_id"].alias("modified_by"), F.count_distinct("author").alias("authors"))


@query("file_facts", "SELECT f.path, f.lines, coalesce(c.class, 'unknown') AS class, count(*) OVER () AS total FROM file f LEFT JOIN (SELECT file, CASE WHEN count(DISTINCT flag) = 1 THEN max(flag) END AS class FROM change GROUP BY file) c ON c.file = f.file")
def file_facts(t):
    from tessera.operators.opinions import agreed

    stated = t.change.groupBy("file").agg(agreed("flag").alias("class"))
    total = t.file.agg(F.count(F.lit(1)).alias("total"))  # one row, instead of a window over everything
    return t.file.join(stated, "file", "left").select("path", "lines", F.coalesce("class", F.lit("unknown")).alias("class")).crossJoin(total)


@query("json_aggregate", "SELECT o_custkey AS customer, string_agg(CAST(o_orderkey AS VARCHAR) || '=' || o_orderstatus, ';' ORDER BY o_orderkey) AS orders, count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders GROUP BY o_custkey")
def json_aggregate(t):
    pairs = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    text = F.array_join(F.transform(pairs, lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit("="), x["o_orderstatus"])), ";")
    return t.orders.groupBy(F.col("o_custkey").alias("customer")).agg(text.alias("orders"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("open"))


@query("distinct_on", "SELECT o_custkey AS customer, o_orderkey AS id, o_orderpriority AS priority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) x WHERE rn = 1")
def distinct_on(t):
    last = t.orders.groupBy(F.col("o_custkey").alias("customer")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderpriority")).alias("m"))
    return last.select("customer", F.col("m.o_orderkey").alias("id"), F.col("m.o_orderpriority").alias("priority"))
