"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.lineage import spread
from tessera.operators import connections as C
from tessera.operators import cycles as C_
from tessera.operators import graph as G
from tessera.operators import history as H
from tessera.plans.registry import query

#: Line items for one task, where the edges they give are dealt.
LINES = 250_000

#: Nodes for one task, where they meet edges.
NODES = 250_000


def _tasks(t):
    """Tasks that the edges of all line items ask for, two of each at most."""
    return -(-t.lineitem.count() // LINES)


#: Containment from the outside in.
DOWN = "SELECT dst AS src, src AS dst FROM edge WHERE rel IN ('in_region', 'in_nation') UNION ALL SELECT src, dst FROM edge WHERE rel = 'placed'"


def _down(t):
    e = t.edge
    return e.where("rel IN ('in_region', 'in_nation')").select(F.col("dst").alias("src"), F.col("src").alias("dst")).unionByName(e.where("rel = 'placed'").select("src", "dst"))


def _related(depth):
    hops = [f"h{i} AS (SELECT DISTINCT h.origin, d.dst AS node FROM h{i - 1} h JOIN down d ON d.src = h.node WHERE d.dst <> h.origin AND d.dst IN (SELECT id FROM node WHERE NOT removed))" for i in range(1, depth + 1)]
    union = " UNION ALL ".join(f"SELECT origin, node, CAST({i} AS INTEGER) AS hops FROM h{i}" for i in range(1, depth + 1))
    sql = f"WITH down AS ({DOWN}), h0 AS (SELECT id AS origin, id AS node FROM node WHERE kind IN ('region', 'nation')), {', '.join(hops)} SELECT origin, node, min(hops) AS hops FROM ({union}) u GROUP BY origin, node"

    @query(f"related_depth{depth}", sql)
    def run(t):
        return G.related(t.node.where("kind IN ('region', 'nation')"), _down(t), depth, t.node.where("NOT removed"))

    return run


for _d in (1, 2, 3):
    _related(_d)


@query(
    "cochange",
    """WITH p AS (SELECT DISTINCT src AS near, dst AS id FROM edge WHERE rel = 'supplied_by'), n AS (SELECT a.id, b.id AS other, count(*) AS n FROM p a JOIN p b ON a.near = b.near AND a.id <> b.id GROUP BY 1, 2 HAVING count(*) >= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, other) AS rn FROM n)
    SELECT r.id, r.other, r.n, t.total, round(r.n / t.total * 100, 6) AS share, CAST(r.rn AS INTEGER) AS rn FROM r JOIN (SELECT id, count(*) AS total FROM p GROUP BY id) t ON t.id = r.id WHERE rn <= 10""",
)
def cochange(t):
    return G.cochange(t.edge.where("rel = 'supplied_by'"), 10, tasks=_tasks(t))


@query(
    "cochange_both",
    """WITH p AS (SELECT src AS near, dst AS id FROM edge WHERE rel = 'touched' UNION SELECT dst, src FROM edge WHERE rel = 'touched'), n AS (SELECT a.id, b.id AS other, count(*) AS n FROM p a JOIN p b ON a.near = b.near AND a.id <> b.id GROUP BY 1, 2 HAVING count(*) >= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, other) AS rn FROM n)
    SELECT r.id, r.other, r.n, t.total, round(r.n / t.total * 100, 6) AS share, CAST(r.rn AS INTEGER) AS rn FROM r JOIN (SELECT id, count(*) AS total FROM p GROUP BY id) t ON t.id = r.id WHERE rn <= 10""",
)
def cochange_both(t):
    return G.cochange(t.edge.where("rel = 'touched'"), 10, both=True, tasks=_tasks(t))


@query(
    "related_page",
    """WITH e AS (SELECT dst AS src, src AS dst FROM edge WHERE rel IN ('in_region', 'in_nation')), l AS (SELECT * FROM node WHERE NOT removed),
    h1 AS (SELECT o.id AS origin, e.dst AS node FROM node o JOIN e ON e.src = o.id JOIN l ON l.id = e.dst WHERE o.kind = 'region'), h2 AS (SELECT DISTINCT h.origin, e.dst AS node FROM h1 h JOIN e ON e.src = h.node JOIN l ON l.id = e.dst),
    f AS (SELECT h.origin, h.node, h.hops, l.label FROM (SELECT origin, node, 1 AS hops FROM h1 UNION SELECT origin, node, 2 FROM h2) h JOIN l ON l.id = h.node WHERE l.kind = 'customer' AND l.label LIKE '%7')
    SELECT origin, node, CAST(hops AS INTEGER) AS hops, label, total, CAST(rn AS INTEGER) AS rn FROM (SELECT *, count(*) OVER (PARTITION BY origin) AS total, row_number() OVER (PARTITION BY origin ORDER BY label DESC, node) AS rn FROM f) x WHERE rn <= 6""",
)
def related_page(t):
    e = t.edge.where("rel IN ('in_region', 'in_nation')")
    tasks = -(-t.node.count() // NODES)
    rows = G.related_page(t.node.where("kind = 'region'"), e, t.node, 2, [F.desc("label")], 5, inverse=True, kinds=["customer"], condition=F.col("label").like("%7"), tasks=tasks)
    return rows.select("origin", "node", "hops", "label", "total", "rn")


@query(
    "contributors",
    """SELECT dst, far, n, CAST(rn AS INTEGER) AS rn FROM (SELECT dst, far, n, row_number() OVER (PARTITION BY dst ORDER BY n DESC, far) AS rn FROM
    (SELECT e.dst, p.src AS far, count(*) AS n FROM edge e JOIN edge p ON p.dst = e.src AND p.rel = 'placed' WHERE e.rel = 'touched' GROUP BY 1, 2) x) y WHERE rn <= 5""",
)
def contributors(t):
    return G.contributors(t.edge.where("rel = 'placed'"), t.edge.where("rel = 'touched'"), 5)


@query(
    "backlinks",
    """WITH l AS (SELECT DISTINCT target, rel, holder FROM (SELECT dst AS target, rel, src AS holder FROM edge WHERE rel <> 'placed' UNION ALL SELECT 2000000000000 + c_nationkey, 'ref_nation', 3000000000000 + c_custkey FROM customer) u)
    SELECT target, rel, holder, total, CAST(rn AS INTEGER) AS rn FROM (SELECT *, count(*) OVER (PARTITION BY target) AS total, row_number() OVER (PARTITION BY target ORDER BY rel, holder) AS rn FROM l) x WHERE rn <= 5""",
)
def backlinks(t):
    refs = t.customer.select((F.col("c_nationkey") + 2_000_000_000_000).alias("target"), F.lit("ref_nation").alias("rel"), (F.col("c_custkey") + 3_000_000_000_000).alias("holder"))
    links = t.edge.where("rel <> 'placed'").select(F.col("dst").alias("target"), "rel", F.col("src").alias("holder")).unionByName(refs)
    # a line item gives two edges at most; a target lies in eight tasks, so that the ranks keep few rows of each
    links = links.withColumn("part", F.pmod(F.xxhash64("holder"), F.lit(8)))
    links = spread(links, _tasks(t), "target", "part").distinct().drop("part")
    return C.grouped_top(links, ["target"], [F.asc("rel"), F.asc("holder")], 5)


@query("outgoing", "SELECT holder, rel, target, total, CAST(rn AS INTEGER) AS rn FROM (SELECT src AS holder, rel, dst AS target, count(*) OVER (PARTITION BY src) AS total, row_number() OVER (PARTITION BY src ORDER BY rel, dst) AS rn FROM edge) x WHERE rn <= 3")
def outgoing(t):
    return C.grouped_top(t.edge.select(F.col("src").alias("holder"), "rel", F.col("dst").alias("target")), ["holder"], [F.asc("rel"), F.asc("target")], 3)


BOTH = """b AS (SELECT e.src AS id, 'out' AS side, e.rel, e.dst AS other, n.kind FROM edge e JOIN node n ON n.id = e.dst
    UNION ALL SELECT e.dst, 'in', e.rel, e.src, n.kind FROM edge e JOIN node n ON n.id = e.src WHERE e.src <> e.dst)"""


@query("neighbourhood", f"WITH {BOTH} SELECT id, side, rel, kind, other, total, CAST(rn AS INTEGER) AS rn, total > 4 AS truncated FROM (SELECT *, count(*) OVER (PARTITION BY id, side, rel, kind) AS total, row_number() OVER (PARTITION BY id, side, rel, kind ORDER BY other) AS rn FROM b) x WHERE rn <= 4")
def neighbourhood(t):
    tasks = _tasks(t)
    rows = C.combined_top(G.both_sides(t.edge, t.node, tasks), ["id", "side", "rel", "kind"], "other", 4, tasks)
    return rows.withColumn("truncated", F.col("total") > 4)


@query("neighbourhood_fold", f"WITH {BOTH}, c AS (SELECT *, count(*) OVER (PARTITION BY id, side, rel, kind) AS total FROM b) SELECT id, side, rel, kind, CASE WHEN total <= 4 THEN other END AS member, max(CASE WHEN total > 4 THEN total END) AS folded FROM c GROUP BY 1, 2, 3, 4, 5")
def neighbourhood_fold(t):
    tasks = _tasks(t)
    return G.fold(G.both_sides(t.edge, t.node, tasks), ["id", "side", "rel", "kind"], "other", 4, tasks)


@query("trail", "SELECT c.id, CAST(r.dst AS VARCHAR) || '/' || CAST(c.dst AS VARCHAR) AS trail FROM (SELECT src AS id, dst FROM edge WHERE rel = 'in_nation') c JOIN edge r ON r.rel = 'in_region' AND r.src = c.dst UNION ALL SELECT src, CAST(dst AS VARCHAR) FROM edge WHERE rel = 'in_region'")
def trail(t):
    parents = t.edge.where("rel IN ('in_region', 'in_nation')").select("src", "dst")
    return G.trail(parents.select(F.col("src").alias("id")), parents, 4)


CHAIN = "WITH RECURSIVE chain AS (SELECT src, dst, 1 AS steps FROM renamed UNION ALL SELECT c.src, r.dst, c.steps + 1 FROM chain c JOIN renamed r ON r.src = c.dst)"


@query("rename_chain", f"{CHAIN} SELECT src AS id, dst AS root, CAST(steps AS BIGINT) AS steps FROM chain WHERE dst NOT IN (SELECT src FROM renamed)")
def rename_chain(t):
    return G.chains(t.renamed)


@query(
    "file_history",
    f"""{CHAIN}, names AS (SELECT src AS file, dst AS name FROM chain UNION ALL SELECT p_partkey, p_partkey FROM part), x AS (SELECT c.repository, n.file, c.commit_id, c.committed_at, c.author, c.walk FROM names n JOIN change h ON h.file = n.name JOIN commit c ON c.commit_id = h.commit_id WHERE n.file NOT IN (SELECT dst FROM renamed)),
    r AS (SELECT *, row_number() OVER (PARTITION BY repository, file ORDER BY walk DESC, commit_id) AS deep, row_number() OVER (PARTITION BY repository, file ORDER BY walk, commit_id) AS shallow FROM x)
    SELECT repository, file, count(DISTINCT commit_id) AS commits, count(DISTINCT author) AS authors, max(CASE WHEN deep = 1 THEN commit_id END) AS created_in, max(CASE WHEN deep = 1 THEN committed_at END) AS created_at, max(CASE WHEN deep = 1 THEN author END) AS created_by,
      max(CASE WHEN shallow = 1 THEN commit_id END) AS modified_in, max(CASE WHEN shallow = 1 THEN committed_at END) AS modified_at, max(CASE WHEN shallow = 1 THEN author END) AS modified_by FROM r GROUP BY repository, file""",
)
def file_history(t):
    """One row for every file that still bears its name, by repository: the changes of all its names, gathered under the
    chain's root, created by the deepest commit of the walk and modified by the shallowest."""
    names = t.part.select(F.col("p_partkey").alias("name"))
    rooted = names.join(G.chains(t.renamed).select(F.col("id").alias("name"), "root"), "name", "left").select("name", F.coalesce("root", "name").alias("root"))
    current = rooted.join(t.renamed.select(F.col("dst").alias("name")), "name", "left_anti").select("root", F.col("name").alias("file"))
    tasks = _tasks(t)
    changes = spread(t.change.select("file", "commit_id"), tasks, "commit_id").join(t.commit, "commit_id")
    dates = H.file_dates(changes, rooted.withColumnRenamed("name", "file"), tasks)
    return spread(dates, tasks, "root").join(current, "root").drop("root")


@query("dependency_lists", "SELECT id, max(df) AS derives_from, max(db) AS derived_by FROM (SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS df, NULL AS db FROM edge WHERE rel IN ('in_region', 'in_nation') GROUP BY src UNION ALL SELECT dst, NULL, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) FROM edge WHERE rel IN ('in_region', 'in_nation') GROUP BY dst) x GROUP BY id")
def dependency_lists(t):
    e = t.edge.where("rel IN ('in_region', 'in_nation')")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x.cast("string")), ",")
    a = e.groupBy(F.col("src").alias("id")).agg(joined("dst").alias("derives_from"))
    b = e.groupBy(F.col("dst").alias("id")).agg(joined("src").alias("derived_by"))
    return a.join(b, "id", "full")


@query("topological_levels", "WITH RECURSIVE d AS (SELECT p_partkey AS id, CAST(floor(p_partkey / 8) AS BIGINT) AS dep FROM part WHERE p_partkey > 0), l AS (SELECT p_partkey AS id, 0 AS level FROM part WHERE p_partkey = 0 UNION ALL SELECT d.id, l.level + 1 FROM d JOIN l ON l.id = d.dep) SELECT id, level FROM l")
def topological_levels(t):
    edges = t.part.where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 8).alias("dst"))
    return G.levels(edges, t.part.select(F.col("p_partkey").alias("id")))


@query(
    "starved_stages",
    """WITH RECURSIVE p AS (SELECT p_partkey AS stage, CAST(floor(p_partkey / 8) AS BIGINT) AS cap, p_size = 50 AS retired FROM part WHERE p_partkey > 0), w AS (SELECT p.stage, 1 AS steps, CAST(p.cap AS VARCHAR) AS path FROM p JOIN part q ON q.p_partkey = p.cap WHERE q.p_size = 50
      UNION ALL SELECT p.stage, w.steps + 1, CAST(p.cap AS VARCHAR) || '>' || w.path FROM w JOIN p ON p.cap = w.stage AND w.stage NOT IN (SELECT p_partkey FROM part WHERE p_size = 50))
    SELECT stage, CAST(steps AS INTEGER) AS steps, path FROM w""",
)
def starved_stages(t):
    """Parts as stages that need the part of an eighth of their number; those of size 50 provide nothing."""
    k = F.col("p_partkey")
    needs = t.part.where("p_partkey > 0").select(k.alias("stage"), F.floor(k / 8).alias("capability"))
    return G.starved(needs, t.part.where("p_size <> 50").select(k.alias("stage"), k.alias("capability")))


@query("dependency_cycles", "WITH RECURSIVE d AS (SELECT p_partkey AS a, CASE WHEN p_partkey % 10 < 3 THEN p_partkey - p_partkey % 10 + (p_partkey % 10 + 1) % 3 ELSE p_partkey - 1 END AS b FROM part), c AS (SELECT a, b FROM d UNION SELECT c.a, d.b FROM c JOIN d ON d.a = c.b) SELECT DISTINCT a AS id FROM c WHERE a = b")
def dependency_cycles(t):
    k = F.col("p_partkey")
    return G.on_cycles(t.part.select(k.alias("src"), F.when(k % 10 < 3, k - k % 10 + (k % 10 + 1) % 3).otherwise(k - 1).alias("dst")))


LINKS = """l AS (SELECT p_partkey AS a, CASE WHEN p_partkey % 10 < 3 THEN p_partkey - p_partkey % 10 + (p_partkey % 10 + 1) % 3 ELSE p_partkey - 1 END AS b FROM part
    UNION SELECT p_partkey, p_partkey + 10 FROM part WHERE p_size % 5 = 0 AND p_partkey % 100 < 90 AND p_partkey + 10 IN (SELECT p_partkey FROM part) UNION SELECT p_partkey, p_partkey - 10 FROM part WHERE p_size % 7 = 0 AND p_partkey % 100 >= 10)"""


@query("dependency_components", f"WITH RECURSIVE {LINKS}, c AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b) SELECT n.a AS id, least(n.a, min(c.b)) AS component FROM (SELECT DISTINCT a FROM l) n LEFT JOIN c ON c.a = n.a AND EXISTS (SELECT 1 FROM c d WHERE d.a = c.b AND d.b = c.a) GROUP BY n.a")
def dependency_components(t):
    """Groups of parts that depend on one another: rings of three, chains into them, and links to the same place ten before or
    after, within each hundred."""
    k = F.col("p_partkey")
    ring = t.part.select(k.alias("src"), F.when(k % 10 < 3, k - k % 10 + (k % 10 + 1) % 3).otherwise(k - 1).alias("dst"))
    on = t.part.where((F.col("p_size") % 5 == 0) & (k % 100 < 90)).select(k.alias("src"), (k + 10).alias("dst")).join(t.part.select(k.alias("dst")), "dst", "left_semi")
    back = t.part.where((F.col("p_size") % 7 == 0) & (k % 100 >= 10)).select(k.alias("src"), (k - 10).alias("dst"))
    return C_.components(ring.unionByName(on.select("src", "dst")).unionByName(back))


CYCLE = "WITH RECURSIVE d AS (SELECT p_partkey AS a, CASE WHEN p_partkey % 10 < 3 THEN p_partkey - p_partkey % 10 + (p_partkey % 10 + 1) % 3 ELSE p_partkey - 1 END AS b FROM part), w AS (SELECT 0 AS place, CAST(0 AS BIGINT) AS id UNION ALL SELECT w.place + 1, d.b FROM w JOIN d ON d.a = w.id WHERE w.place = 0 OR w.id <> 0)"


@query("first_cycle", f"{CYCLE} SELECT place, id FROM w")
def first_cycle(t):
    k = F.col("p_partkey")
    return G.first_cycle(t.part.select(k.alias("src"), F.when(k % 10 < 3, k - k % 10 + (k % 10 + 1) % 3).otherwise(k - 1).alias("dst")))


@query(
    "view_lifted",
    """SELECT c.c_nationkey + 2000000000000 AS from_id, s.s_nationkey + 2000000000000 AS to_id, count(*) AS n, min(e.src * 10 + e.dst % 10) AS first_relation, max(e.src * 10 + e.dst % 10) AS last_relation
    FROM edge e JOIN orders o ON o.o_orderkey + 6000000000000 = e.src JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey + 4000000000000 = e.dst WHERE e.rel = 'supplied_by' AND c.c_nationkey <> s.s_nationkey GROUP BY 1, 2""",
)
def view_lifted(t):
    e = t.edge
    parents = e.where("rel IN ('in_region', 'in_nation')").select("src", "dst").unionByName(e.where("rel = 'placed'").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    shown = t.node.where("kind IN ('region', 'nation')").select("id")
    return G.lifted(e.where("rel = 'supplied_by'").select("src", "dst"), G.ancestors(parents, shown, 2), F.col("src") * 10 + F.col("dst") % 10)


@query(
    "view_context",
    """WITH x AS (SELECT l_orderkey AS id, CASE WHEN a.n_regionkey = 1 THEN 2000000000000 + a.n_nationkey ELSE 1000000000000 + a.n_regionkey END AS from_id, CASE WHEN b.n_regionkey = 1 THEN 2000000000000 + b.n_nationkey ELSE 1000000000000 + b.n_regionkey END AS to_id
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation b ON b.n_nationkey = s_nationkey WHERE a.n_regionkey = 1 OR b.n_regionkey = 1)
    SELECT from_id, to_id, count(*) AS n, min(id) AS first_relation, max(id) AS last_relation FROM x WHERE from_id <> to_id GROUP BY 1, 2""",
)
def view_context(t):
    """The nations of one region, and the other regions they trade with: customers to suppliers, by line item."""
    parents = t.edge.where("rel IN ('in_region', 'in_nation')").select(F.col("src").alias("id"), F.col("dst").alias("parent"))
    elements = t.node.where("kind IN ('region', 'nation', 'customer', 'supplier')").select("id").join(parents, "id", "left")
    orders = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") + 3_000_000_000_000).alias("src"))
    relations = t.lineitem.select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") + 4_000_000_000_000).alias("dst")).join(orders, "id")
    return G.view(elements, relations, 1_000_000_000_001, 1, context=True, levels=3)


@query(
    "view_refined_once",
    """WITH x AS (SELECT l_suppkey, c_custkey, s_nationkey + 2000000000000 AS a, c_nationkey + 2000000000000 AS b, l_quantity, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
    coarse AS (SELECT DISTINCT a, b FROM x WHERE l_quantity >= 50), fine AS (SELECT DISTINCT l_suppkey, c_custkey, a, b FROM x WHERE l_quantity >= 48 AND o_orderpriority = '1-URGENT')
    SELECT a AS from_id, b AS to_id, count(*) AS n FROM (SELECT a, b FROM coarse UNION ALL SELECT a, b FROM fine WHERE NOT EXISTS (SELECT 1 FROM coarse c WHERE c.a = fine.a AND c.b = fine.b)) u WHERE a <> b GROUP BY 1, 2""",
)
def view_refined_once(t):
    """Large shipments between nations, and urgent ones between a supplier and a customer, which refine them: a refinement
    counts only where the relation it refines isn't drawn."""
    rows = t.lineitem.select("l_quantity", F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    rows = rows.join(t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderpriority"), "o_orderkey").join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey").join(t.supplier.select("s_suppkey", "s_nationkey"), "s_suppkey")
    ends = {"a": F.col("s_nationkey") + 2_000_000_000_000, "b": F.col("c_nationkey") + 2_000_000_000_000, "s": F.col("s_suppkey") + 4_000_000_000_000, "c": F.col("c_custkey") + 3_000_000_000_000}
    rows = rows.withColumns({k: v.cast("long") for k, v in ends.items()})
    name = lambda *cols: F.concat_ws(">", *[F.col(c).cast("string") for c in cols])
    coarse = rows.where("l_quantity >= 50").select(name("a", "b").alias("id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(None).cast("string").alias("refines"))
    fine = rows.where("l_quantity >= 48 AND o_orderpriority = '1-URGENT'").select(name("s", "c").alias("id"), F.col("s").alias("src"), F.col("c").alias("dst"), name("a", "b").alias("refines"))
    relations = coarse.unionByName(fine).distinct()
    above = G.ancestors(t.edge.where("rel = 'in_nation'").select("src", "dst"), t.node.where("kind = 'nation'").select("id"), 1)
    crossing = relations.join(above.select(F.col("id").alias("src"), F.col("shown").alias("x")), "src").join(above.select(F.col("id").alias("dst"), F.col("shown").alias("y")), "dst").where("x <> y")
    return G.lifted(G.without_refinements(relations, crossing), above, F.col("id")).select("from_id", "to_id", "n")


DEP = "WITH e AS (SELECT rel, src, dst FROM edge WHERE rel IN ('in_region', 'in_nation') UNION ALL SELECT rel, dst, src FROM edge WHERE rel = 'placed'), h1 AS (SELECT n.id AS origin, e.src AS node, e.rel AS chain FROM node n JOIN e ON e.dst = n.id WHERE n.kind = 'region'), h2 AS (SELECT h.origin, e.src AS node, h.chain || '>' || e.rel AS chain FROM h1 h JOIN e ON e.dst = h.node), h3 AS (SELECT h.origin, e.src AS node, h.chain || '>' || e.rel AS chain FROM h2 h JOIN e ON e.dst = h.node)"


@query("dependents", f"{DEP} SELECT origin, node, 1 AS hops, chain FROM h1 UNION ALL SELECT origin, node, 2, chain FROM h2 UNION ALL SELECT origin, node, 3, chain FROM h3")
def dependents(t):
    e = t.edge.where("rel IN ('in_region', 'in_nation')").select("rel", "src", "dst").unionByName(t.edge.where("rel = 'placed'").select("rel", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return G.dependents(t.node.where("kind = 'region'"), e, 3)


AT = 900_000_000_000


@query(
    "dependents_asof",
    f"""WITH h AS (SELECT rel, src, dst FROM held WHERE valid_from <= {AT} AND (valid_to IS NULL OR valid_to > {AT})), a AS (SELECT DISTINCT dst AS origin, src AS node, rel AS chain FROM h WHERE dst IN (SELECT id FROM node WHERE kind = 'customer')),
    b AS (SELECT DISTINCT a.origin, h.src AS node, a.chain || '>' || h.rel AS chain FROM a JOIN h ON h.dst = a.node) SELECT origin, node, 1 AS hops, chain FROM a UNION ALL SELECT origin, node, 2, chain FROM b""",
)
def dependents_asof(t):
    return G.dependents_as_of(t.node.where("kind = 'customer'"), t.held, 2, AT)


@query("dependencies", "SELECT a.src AS origin, a.dst AS node, 1 AS hops, a.rel AS chain FROM edge a WHERE a.rel IN ('in_nation', 'in_region') UNION ALL SELECT a.src, b.dst, 2, a.rel || '>' || b.rel FROM edge a JOIN edge b ON b.src = a.dst AND b.rel = 'in_region' WHERE a.rel = 'in_nation'")
def dependencies(t):
    e = t.edge.where("rel IN ('in_nation', 'in_region')").select("rel", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.dependents(t.node, e, 3)


@query("children_by_parent", "SELECT dst AS parent, count(*) AS n, string_agg(CAST(src AS VARCHAR), ',' ORDER BY CAST(src AS VARCHAR)) AS children FROM edge WHERE rel = 'in_nation' GROUP BY dst")
def children_by_parent(t):
    kids = F.array_join(F.array_sort(F.collect_list(F.col("src").cast("string"))), ",")
    return t.edge.where("rel = 'in_nation'").groupBy(F.col("dst").alias("parent")).agg(F.count(F.lit(1)).alias("n"), kids.alias("children"))
