"""Writer, consistency and queue queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators import writer as R
from tessera.operators.machines import Machine, Step, follow
from tessera.operators.temporal import positions
from tessera.plans.registry import query


@query("declare_vertices", "SELECT b.id, CASE WHEN n.id IS NULL THEN 'inserted' ELSE 'revived' END AS action FROM (SELECT DISTINCT 3000000000000 + user_id * 7 AS id FROM event) b LEFT JOIN node n ON n.id = b.id WHERE n.id IS NULL OR n.removed")
def declare_vertices(t):
    return R.declare(t.node, t.event.select((F.col("user_id") * 7 + 3_000_000_000_000).alias("id")))


BATCH = "SELECT event_id + 1000000 AS id, user_id * 20 + k % 20 AS holder, event_type AS producer, 'en' AS lang, 'g' || CAST(event_id % 3 AS VARCHAR) AS grade, 'file' || CAST(event_id % 50 AS VARCHAR) || ':' || CAST(k + 1 AS VARCHAR) AS evidence FROM event WHERE event_type = 'purchase'"


def _batch(t):
    return t.event.where("event_type = 'purchase'").selectExpr(
        "event_id + 1000000 AS id", "user_id * 20 + k % 20 AS holder", "event_type AS producer", "'en' AS lang", "'g' || CAST(event_id % 3 AS STRING) AS grade",
        "'file' || CAST(event_id % 50 AS STRING) || ':' || CAST(k + 1 AS STRING) AS evidence",
    )


@query("state_opinion", f"""WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY holder, producer, lang ORDER BY id DESC) AS n FROM ({BATCH}) x) y WHERE n = 1), o AS (SELECT * FROM opinion WHERE state = 'open'),
    j AS (SELECT b.holder, b.producer, b.lang, b.id AS new_id, o.id AS old_id, CASE WHEN o.id IS NULL THEN 'opened' WHEN b.grade IS DISTINCT FROM o.grade THEN 'replaced' WHEN b.evidence IS DISTINCT FROM o.evidence THEN 're-evidenced' ELSE 'unchanged' END AS action
      FROM b LEFT JOIN o ON o.holder = b.holder AND o.producer = b.producer AND o.lang IS NOT DISTINCT FROM b.lang)
    SELECT holder, producer, lang, new_id, CASE WHEN action = 'replaced' THEN old_id END AS closes, action FROM j""")
def state_opinion(t):
    return R.state_opinions(t.opinion, _batch(t), ["holder", "producer", "lang"], ["grade"], "id")


@query("partial_opinion", f"""WITH b AS (SELECT holder, max(grade) AS grade, CAST(NULL AS VARCHAR) AS title, max(evidence) AS evidence FROM ({BATCH}) x GROUP BY holder), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY holder ORDER BY id DESC) AS n FROM opinion WHERE state = 'open') y WHERE n = 1)
    SELECT b.holder, coalesce(b.grade, o.grade) AS grade, o.title, CASE WHEN o.evidence IS NULL OR o.evidence = b.evidence THEN b.evidence ELSE least(o.evidence, b.evidence) || ',' || greatest(o.evidence, b.evidence) END AS evidence FROM b LEFT JOIN o ON o.holder = b.holder""")
def partial_opinion(t):
    stored = t.opinion.where("state = 'open'").groupBy("holder").agg(F.max(F.struct("id", "grade", "title", "evidence")).alias("m")).select("holder", "m.grade", "m.title", "m.evidence")
    batch = _batch(t).groupBy("holder").agg(F.max("grade").alias("grade"), F.max("evidence").alias("evidence")).withColumn("title", F.lit(None).cast("string"))
    return R.merge_partial(stored, batch, "holder", ["grade", "title"])


@query("retraction", """WITH h AS (SELECT holder, count(*) FILTER (WHERE producer = 'view' AND state = 'open') AS closed, count(*) FILTER (WHERE state IN ('open', 'confirmed') AND NOT (producer = 'view' AND state = 'open')) AS rest FROM opinion GROUP BY holder)
    SELECT holder, closed, rest = 0 AND holder NOT IN (SELECT o_custkey FROM orders) AS removed FROM h WHERE closed > 0""")
def retraction(t):
    return R.retract(t.opinion, t.orders.select(F.col("o_custkey").alias("holder")), "view")


@query(
    "edge_withdrawal",
    """WITH o AS (SELECT DISTINCT 'touched' AS rel, 6000000000000 + l_orderkey AS src, 5000000000000 + l_partkey AS dst, l_returnflag AS producer FROM lineitem), h AS (SELECT rel, src, dst, count(*) FILTER (WHERE producer = 'R') AS closed, count(*) FILTER (WHERE producer <> 'R') AS rest FROM o GROUP BY 1, 2, 3)
    SELECT e.rel, e.src, e.dst, h.closed, h.rest = 0 AS removed FROM edge e JOIN h ON h.rel = e.rel AND h.src = e.src AND h.dst = e.dst WHERE h.closed > 0""",
)
def edge_withdrawal(t):
    """The producer 'R' withdraws its edges; an edge goes when no other producer states it."""
    stated = t.lineitem.select(F.lit("touched").alias("rel"), (F.col("l_orderkey") + 6_000_000_000_000).alias("src"), (F.col("l_partkey") + 5_000_000_000_000).alias("dst"), F.col("l_returnflag").alias("producer")).distinct()
    return R.withdraw_edges(t.edge, stated, "R")


@query("publish_edges", "SELECT e.rel, e.src, e.dst, CASE WHEN a.id IS NULL AND b.id IS NULL THEN 'from+to' WHEN a.id IS NULL THEN 'from' WHEN b.id IS NULL THEN 'to' ELSE 'published' END AS outcome FROM edge e LEFT JOIN node a ON a.id = e.src AND NOT a.removed LEFT JOIN node b ON b.id = e.dst AND NOT b.removed")
def publish_edges(t):
    return R.publish_edges(t.edge.select("rel", "src", "dst"), t.node)


@query("unresolved_references", "SELECT o.id, o.holder FROM opinion o WHERE o.state = 'open' AND o.holder NOT IN (SELECT c_custkey FROM customer) AND EXISTS (SELECT 1 FROM opinion p WHERE p.producer = o.producer AND p.holder = o.holder AND p.state = 'open' AND p.evidence IS NOT NULL)")
def unresolved_references(t):
    o = t.opinion.where("state = 'open'")
    rows = o.select("id", "holder", "producer").join(t.customer.select(F.col("c_custkey").alias("holder")), "holder", "left_anti")
    return rows.join(o.where("evidence IS NOT NULL").select("holder", "producer"), ["holder", "producer"], "left_semi").select("id", "holder")


@query("removed_edge_ends", "SELECT e.rel, e.src, e.dst, concat_ws(',', CASE WHEN a.removed THEN 'from' END, CASE WHEN b.removed THEN 'to' END) AS ends FROM edge e JOIN node a ON a.id = e.src JOIN node b ON b.id = e.dst WHERE a.removed OR b.removed")
def removed_edge_ends(t):
    gone = t.node.where("removed").select("id")
    a, b = gone.select(F.col("id").alias("src"), F.lit("from").alias("a")), gone.select(F.col("id").alias("dst"), F.lit("to").alias("b"))
    rows = t.edge.join(a, "src", "left").join(b, "dst", "left").where("a IS NOT NULL OR b IS NOT NULL")
    return rows.select("rel", "src", "dst", F.concat_ws(",", "a", "b").alias("ends"))


@query("unevidenced", "SELECT id, 'grade' AS field FROM opinion WHERE state = 'open' AND evidence IS NULL AND grade IS NOT NULL UNION ALL SELECT id, 'title' FROM opinion WHERE state = 'open' AND evidence IS NULL AND title IS NOT NULL UNION ALL SELECT id, 'amount' FROM opinion WHERE state = 'open' AND evidence IS NULL AND amount IS NOT NULL")
def unevidenced(t):
    rows = t.opinion.where("state = 'open' AND evidence IS NULL")
    return rows.select("id", F.expr("stack(3, 'grade', grade, 'title', title, 'amount', CAST(amount AS STRING)) AS (field, v)")).where("v IS NOT NULL").select("id", "field")


@query("journal_entries", "SELECT row_number() OVER (ORDER BY min(event_id)) AS seq, user_id AS author, tick // 1000 AS second, count(*) AS changes, count(*) FILTER (WHERE event_type = 'signup') AS vertices, count(*) FILTER (WHERE event_type = 'error') AS withdrawals, min(event_id) AS first_event FROM event GROUP BY user_id, tick // 1000")
def journal_entries(t):
    """One entry for each publication, an author's changes of one second, numbered in the order they came in."""
    kind = F.col("event_type")
    entries = t.event.groupBy(F.col("user_id").alias("author"), F.floor(F.col("tick") / 1_000).alias("second")).agg(
        F.count(F.lit(1)).alias("changes"), F.count(F.when(kind == "signup", 1)).alias("vertices"), F.count(F.when(kind == "error", 1)).alias("withdrawals"), F.min("event_id").alias("first_event")
    )
    numbered = positions(entries.withColumn("all", F.lit(0)), "all", [F.asc("first_event")], [], "seq")
    return numbered.withColumn("seq", F.col("seq").cast("long")).drop("all")


@query("declaration_diff", """WITH c AS (SELECT o_orderkey AS id, o_orderstatus AS v FROM orders WHERE o_orderpriority <> '2-HIGH'), w AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderpriority <> '3-MEDIUM')
    SELECT coalesce(c.id, w.id) AS id, CASE WHEN c.id IS NULL THEN 'added' WHEN w.id IS NULL THEN 'removed' ELSE 'changed' END AS action FROM c FULL JOIN w ON c.id = w.id WHERE c.v IS DISTINCT FROM w.v""")
def declaration_diff(t):
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v"), F.col("o_orderpriority").alias("p"))
    wanted = o.where("p <> '3-MEDIUM'").withColumn("v", F.when(F.col("p") == "1-URGENT", "X").otherwise(F.col("v")))
    return R.diff(o.where("p <> '2-HIGH'"), wanted, "id", ["v"])


@query("membership_digest", "SELECT kind, count(*) AS n, CAST(sum(CAST(('0x' || substr(sha256(concat_ws('|', CAST(id AS VARCHAR), label)), 1, 12)) AS BIGINT)) AS VARCHAR) AS digest FROM node GROUP BY kind")
def membership_digest(t):
    return R.membership_digest(t.node, "kind", ["id", "label"])


@query(
    "staleness",
    """WITH now AS (SELECT repository AS kind, count(*) AS n, CAST(sum(CAST(('0x' || substr(sha256(concat_ws('|', CAST(file AS VARCHAR), CAST(lines AS VARCHAR))), 1, 12)) AS BIGINT)) AS VARCHAR) AS digest FROM file GROUP BY repository),
    was AS (SELECT repository AS kind, count(*) AS n, CAST(sum(CAST(('0x' || substr(sha256(concat_ws('|', CAST(file AS VARCHAR), CAST(CASE WHEN path LIKE '%/red %' AND repository < 'Brand#2' THEN lines + 1 ELSE lines END AS VARCHAR))), 1, 12)) AS BIGINT)) AS VARCHAR) AS digest
      FROM file WHERE NOT (repository LIKE 'Brand#2%' AND lines = 2000) GROUP BY repository),
    own AS (SELECT coalesce(now.kind, was.kind) AS kind, CASE WHEN now.n IS DISTINCT FROM was.n THEN 'membership' WHEN now.digest IS DISTINCT FROM was.digest THEN 'content' END AS reason FROM now FULL JOIN was ON was.kind = now.kind),
    consumed AS (SELECT kind, lag(kind) OVER (ORDER BY kind) AS of FROM now)
    SELECT own.kind, coalesce(own.reason, 'consumed ' || c.of) AS reason FROM own LEFT JOIN (SELECT c.kind, c.of FROM consumed c JOIN own o ON o.kind = c.of AND o.reason IS NOT NULL) c ON c.kind = own.kind WHERE own.reason IS NOT NULL OR c.of IS NOT NULL""",
)
def staleness(t):
    """Files by repository against what was recorded; each repository consumes the one before it."""
    rows = lambda f: f.select(F.col("repository").alias("kind"), "file", "lines")
    now = rows(t.file)
    red = F.col("path").like("%/red %") & (F.col("repository") < "Brand#2")
    was = rows(t.file.where("NOT (repository LIKE 'Brand#2%' AND lines = 2000)").withColumn("lines", F.when(red, F.col("lines") + 1).otherwise(F.col("lines"))))
    kinds = now.select("kind").distinct()  # the repositories: a handful
    consumed = kinds.withColumn("of", F.lag("kind").over(W.orderBy("kind"))).where("of IS NOT NULL")
    return R.stale(R.membership_digest(now, "kind", ["file", "lines"]), R.membership_digest(was, "kind", ["file", "lines"]), consumed)


GENERATIONS = """g AS (SELECT s_suppkey AS generation, 'stage' || CAST(s_suppkey % 5 AS {text}) AS stage, CASE WHEN s_suppkey % 4 = 0 THEN 'r1' ELSE 'r2' END AS run, CASE WHEN s_suppkey % 3 = 0 THEN 'running' ELSE 'published' END AS state,
      'i' || CAST(s_suppkey % 7 AS {text}) AS inputs, 'v1' AS versions FROM {supplier})"""
READS = """r AS (SELECT DISTINCT author AS generation, repository AS kind, CASE WHEN author % 11 = 5 THEN x.file + 10000000 WHEN author % 11 = 6 AND lines > 1900 THEN x.file + 10000000 ELSE x.file END AS key,
      CASE WHEN author % 11 = 5 OR author % 11 = 7 AND lines > 1920 THEN NULL WHEN author % 2 = 0 AND path LIKE '%/red %' AND lines > 1900 THEN lines + 1 ELSE lines END AS digest FROM {change} x JOIN {file} f ON f.file = x.file)"""


@query(
    "stale_generations",
    f"""WITH {GENERATIONS.format(text="VARCHAR", supplier="supplier")}, {READS.format(change="change", file="file")},
    m AS (SELECT generation, kind, key, CASE WHEN digest IS NULL THEN 'is no longer empty' WHEN lines IS NULL THEN 'is gone' ELSE 'has moved' END AS how FROM r LEFT JOIN file f ON f.repository = r.kind AND f.file = r.key WHERE digest IS DISTINCT FROM lines),
    f AS (SELECT generation, kind || ' ' || CAST(key AS VARCHAR) || ' ' || how AS read FROM (SELECT *, row_number() OVER (PARTITION BY generation ORDER BY kind, key, how) AS n FROM m) x WHERE n = 1),
    c AS (SELECT g.generation, CASE WHEN g.generation % 13 = 12 THEN 'versions have moved' WHEN g.generation % 17 = 16 THEN 'inputs have moved' WHEN state = 'published' AND read IS NOT NULL THEN 'read ' || read END AS cause
      FROM g LEFT JOIN f ON f.generation = g.generation WHERE run = 'r1' OR state = 'published' AND stage IN ('stage1', 'stage2', 'stage4'))
    SELECT generation, cause IS NULL AS fresh, cause FROM c""",
)
def stale_generations(t):
    """Suppliers as generations that read the files they changed; three of five stages consume what was published, and some of
    their generations stay fresh."""
    g = t.spark.sql(GENERATIONS.format(text="STRING", supplier="{supplier}").join(("WITH ", " SELECT * FROM g")), supplier=t.supplier)
    reads = t.spark.sql(READS.format(change="{change}", file="{file}").join(("WITH ", " SELECT * FROM r")), change=t.change, file=t.file)
    n = F.col("generation")
    now = g.select("generation", F.when(n % 17 == 16, "i9").otherwise(F.col("inputs")).alias("inputs"), F.when(n % 13 == 12, "v2").otherwise(F.col("versions")).alias("versions"))
    facts = t.file.select(F.col("repository").alias("kind"), F.col("file").alias("key"), F.col("lines").alias("digest"))
    kinds = facts.select("kind").distinct()
    consumed = kinds.select("kind", F.explode(F.array(*[F.lit(f"stage{i}") for i in (1, 2, 4)])).alias("stage"))
    return R.recheck(g, now, reads, facts, kinds, consumed, "r1")


@query("refresh_decision", """WITH r AS (SELECT file, 'changed' AS reason FROM change WHERE flag = 'R' UNION SELECT file, 'large' FROM file WHERE lines > 1800 UNION SELECT file, 'language' FROM file WHERE path LIKE '%.md')
    SELECT file, string_agg(reason, ',' ORDER BY reason) AS reasons FROM r GROUP BY file""")
def refresh_decision(t):
    r = t.change.where("flag = 'R'").select("file", F.lit("changed").alias("reason"))
    r = r.unionByName(t.file.where("lines > 1800").select("file", F.lit("large").alias("reason"))).unionByName(t.file.where("path LIKE '%.md'").select("file", F.lit("language").alias("reason")))
    return r.groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


PLACES = """g AS (SELECT 'domain:p' || CAST(file AS VARCHAR) AS page, file, lines FROM file WHERE lines > 400),
      l AS (SELECT DISTINCT g.page, 'order:' || CAST(commit_id AS VARCHAR) AS entry FROM change JOIN g ON g.file = change.file),
      i AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'correction' ELSE 'question' END AS kind, 'i' || CAST(o_orderkey AS VARCHAR) AS slug, 'order:' || CAST(o_orderkey AS VARCHAR) AS first, 'domain:p' || CAST(o_custkey AS VARCHAR) AS second,
        CASE WHEN o_orderkey % 50 = 0 THEN 'domain:p' || CAST(o_custkey % 90 AS VARCHAR) END AS asked_in FROM orders WHERE o_orderkey % 3 <> 0 AND (o_orderstatus = 'F' OR o_orderkey % 7 <> 0)),
      e AS (SELECT kind, slug, first AS entry FROM i WHERE kind = 'question' UNION ALL SELECT kind, slug, second FROM i),
      p AS (SELECT e.kind, slug, g.page FROM e JOIN g ON g.page = e.entry UNION SELECT e.kind, slug, l.page FROM e JOIN l ON l.entry = e.entry UNION SELECT i.kind, slug, asked_in FROM i JOIN g ON g.page = i.asked_in)"""


def _places(t):
    """Pages of the larger files, linked to the orders that changed them; answers and corrections about orders and pages."""
    domain = lambda c: F.concat(F.lit("domain:p"), c.cast("string"))
    key, whom = F.col("o_orderkey"), F.col("o_custkey")
    pages = t.file.where("lines > 400").select(domain(F.col("file")).alias("page"), "file", "lines")
    links = t.change.join(pages, "file").select("page", F.concat(F.lit("order:"), F.col("commit_id").cast("string")).alias("entry"))
    wrong = F.col("o_orderstatus") == "F"
    about = F.when(wrong, F.array(F.concat(domain(whom), F.lit("#claim")))).otherwise(F.array(F.concat(F.lit("order:"), key.cast("string")), domain(whom)))
    status = F.when(key % 3 == 0, F.when(wrong, "closed").otherwise("open")).otherwise(F.when(wrong, "open").otherwise("answered"))
    items = t.orders.select(
        F.when(wrong, "correction").otherwise("question").alias("kind"), F.concat(F.lit("i"), key.cast("string")).alias("slug"), status.alias("status"), (key % 7 == 0).alias("resolved"),
        about.alias("about"), F.when(key % 50 == 0, domain(whom % 90)).alias("asked_in"),
    )
    return pages, links, items


@query(
    "refresh_reasons",
    f"""WITH {PLACES} SELECT page, CASE kind WHEN 'question' THEN 'answer' ELSE kind END AS reason, slug AS ref FROM p
      UNION SELECT page, CASE WHEN lines > 1600 THEN 'ground-changed' ELSE 'ground-removed' END, 'file' FROM g WHERE lines > 1200""",
)
def refresh_reasons(t):
    pages, links, items = _places(t)
    status = F.when(F.col("lines") > 1600, "changed").when(F.col("lines") > 1200, "removed").otherwise("same")
    return R.refresh_reasons(pages, links, items, pages.select("page", F.lit("file").alias("ground"), status.alias("status")))


@query("refresh_unplaced", f"WITH {PLACES} SELECT kind, slug FROM i WHERE NOT EXISTS (SELECT * FROM p WHERE p.slug = i.slug AND p.kind = i.kind)")
def refresh_unplaced(t):
    return R.unplaced(*_places(t)).select("kind", "slug")


JOB = "SELECT event_id AS id, user_id % 5 AS queue, k % 4 AS priority, tick AS due, k % 6 AS attempt, event_type FROM event"


def _jobs(t):
    return t.event.selectExpr("event_id AS id", "user_id % 5 AS queue", "k % 4 AS priority", "tick AS due", "k % 6 AS attempt", "event_type")


@query("queue_order", f"WITH j AS ({JOB}) SELECT queue, id, CAST(row_number() OVER (PARTITION BY queue ORDER BY priority DESC, due, id) AS INTEGER) AS position FROM j WHERE event_type <> 'purchase'")
def queue_order(t):
    jobs = _jobs(t).where("event_type <> 'purchase'").select("queue", "id", "priority", "due")
    return positions(jobs, "queue", [F.desc("priority"), F.asc("due"), F.asc("id")], []).select("queue", "id", "position")


@query("queue_retry", f"WITH j AS ({JOB}) SELECT id, queue, attempt, CASE WHEN attempt >= 4 THEN 'dead' ELSE 'retry' END AS outcome, CASE WHEN attempt < 4 THEN due + CAST(1000 * power(2, attempt) AS BIGINT) END AS next FROM j WHERE event_type = 'error'")
def queue_retry(t):
    rows = _jobs(t).where("event_type = 'error'")
    again = F.when(F.col("attempt") < 4, F.col("due") + (F.pow(F.lit(2.0), F.col("attempt")) * 1000).cast("long"))
    return rows.select("id", "queue", "attempt", F.when(F.col("attempt") >= 4, "dead").otherwise("retry").alias("outcome"), again.alias("next"))


@query("queue_singletons", f"WITH j AS ({JOB}) SELECT queue, attempt AS key, min(id) AS id, count(*) - 1 AS dropped FROM j WHERE event_type = 'view' GROUP BY 1, 2")
def queue_singletons(t):
    return _jobs(t).where("event_type = 'view'").groupBy("queue", F.col("attempt").alias("key")).agg(F.min("id").alias("id"), (F.count(F.lit(1)) - 1).alias("dropped"))


@query("enqueue_stamp", "SELECT event_id, m + rn AS stamp FROM (SELECT event_id, rn, max(tick - rn) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM event) x) y")
def enqueue_stamp(t):
    """A stamp at least 1 ms past the queue's previous one: a running maximum of (time - position), plus the position."""
    by = W.partitionBy("user_id").orderBy("event_id")
    rows = t.event.withColumn("rn", F.row_number().over(by).cast("long"))
    return rows.select("event_id", (F.max(F.col("tick") - F.col("rn")).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("rn")).alias("stamp"))


@query("progress_sequence", "SELECT event_id, user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY tick, event_id) AS INTEGER) AS seq FROM event")
def progress_sequence(t):
    return t.event.select("event_id", F.col("user_id").alias("run"), F.row_number().over(W.partitionBy("user_id").orderBy("tick", "event_id")).alias("seq"))


#: A visit as a state machine: errors end it, if they are severe; what is bought has to be priced and affordable.
VISIT = Machine(
    "visit", "new", ("new", "open", "active", "paying", "failed", "closed"),
    (
        Step("new", "signup", "open"), Step("open", "view", "active"), Step("open", "click", "active"), Step("active", "view", "active"), Step("active", "click", "active"),
        Step("active", "purchase", "paying", ("priced", "affordable")), Step("active", "purchase", "active", ("priced",), "declined"), Step("paying", "view", "active"), Step("paying", "purchase", "paying", ("affordable",)),
        Step("open", "error", "failed", ("severe",)), Step("active", "error", "failed", ("severe",)), Step("paying", "error", "failed"), Step("failed", "signup", "open"), Step("failed", "error", "closed", ("severe", "priced")),
    ),
    {"priced": "k > 20", "affordable": "value < 150", "severe": "k % 3 = 0"},
)
VISITED = """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type AS event, k, value, tick, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM event),
    o AS (SELECT e.*, 'new' AS before, CASE WHEN event = 'signup' THEN 'visit/new--signup-->open' ELSE 'no-transition' END AS outcome FROM e WHERE n = 1
      UNION ALL SELECT event_id, user_id, event, k, value, tick, n, before, CASE
        WHEN before = 'new' AND event = 'signup' THEN 'visit/new--signup-->open'
        WHEN before IN ('open', 'active', 'paying') AND event = 'view' OR before IN ('open', 'active') AND event = 'click' THEN 'visit/' || before || '--' || event || '-->active'
        WHEN before = 'active' AND event = 'purchase' THEN CASE WHEN k <= 20 THEN 'priced' WHEN value < 150 THEN 'visit/active--purchase-->paying' ELSE 'visit/active--purchase-declined-->active' END
        WHEN before = 'paying' AND event = 'purchase' THEN CASE WHEN value < 150 THEN 'visit/paying--purchase-->paying' ELSE 'affordable' END
        WHEN before IN ('open', 'active') AND event = 'error' THEN CASE WHEN k % 3 = 0 THEN 'visit/' || before || '--error-->failed' ELSE 'severe' END
        WHEN before = 'paying' AND event = 'error' THEN 'visit/paying--error-->failed'
        WHEN before = 'failed' AND event = 'signup' THEN 'visit/failed--signup-->open'
        WHEN before = 'failed' AND event = 'error' THEN CASE WHEN k % 3 <> 0 THEN 'severe' WHEN k <= 20 THEN 'priced' ELSE 'visit/failed--error-->closed' END
        ELSE 'no-transition' END
      FROM (SELECT e.*, CASE WHEN o.outcome LIKE 'visit/%' THEN split_part(o.outcome, '-->', 2) ELSE o.before END AS before FROM o JOIN e ON e.user_id = o.user_id AND e.n = o.n + 1) x)
    SELECT event_id, before, CASE WHEN outcome LIKE 'visit/%' THEN split_part(outcome, '-->', 2) ELSE before END AS after, CASE WHEN outcome LIKE 'visit/%' THEN outcome END AS transition,
      CASE WHEN outcome = 'no-transition' THEN 'visit/no-transition' WHEN outcome NOT LIKE 'visit/%' THEN 'visit/guard-refused' END AS code, CASE WHEN outcome NOT LIKE 'visit/%' AND outcome <> 'no-transition' THEN outcome END AS guard FROM o"""


@query("state_transitions", VISITED)
def state_transitions(t):
    """Every event of a user as a step of the visit: the state before and after it, and the transition or why it was refused."""
    rows = follow(VISIT, t.event.select("event_id", "user_id", "event_type", "k", "value"), "user_id", ["event_id"], "event_type")
    return rows.select("event_id", "before", "after", "transition", "code", "guard")


@query("latest_run", "SELECT session, seq, run FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY tick DESC, seq DESC) AS rn FROM usage) x WHERE rn = 1")
def latest_run(t):
    return t.usage.groupBy("session").agg(F.max(F.struct("tick", "seq", "run")).alias("m")).select("session", "m.seq", "m.run")


@query("admission_order", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id % 3 ORDER BY k % 3, event_id - CAST(floor(value / 10) AS BIGINT), event_id) AS INTEGER) AS position FROM event")
def admission_order(t):
    rows = t.event.select("event_id", (F.col("user_id") % 3).alias("queue"), (F.col("k") % 3).alias("rank"), (F.col("event_id") - F.floor(F.col("value") / 10)).alias("since"))
    return positions(rows, "queue", [F.asc("rank"), F.asc("since"), F.asc("event_id")], []).select("event_id", "position")


@query("publications_per_stage", "SELECT event_type AS stage, count(*) AS publications, CAST(coalesce(sum(CASE WHEN k > 95 THEN k END), 0) AS BIGINT) AS facts, count(DISTINCT user_id) AS units FROM event GROUP BY event_type")
def publications_per_stage(t):
    return t.event.groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("publications"), F.coalesce(F.sum(F.when(F.col("k") > 95, F.col("k"))), F.lit(0)).alias("facts"), F.count_distinct("user_id").alias("units"))


@query("fill_progress", "SELECT user_id % 10 AS stage, count(*) FILTER (WHERE event_type = 'signup') AS planned, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS published, count(*) FILTER (WHERE event_type = 'error') AS failed, max(event_id) AS last_pass FROM event GROUP BY 1")
def fill_progress(t):
    kind = F.col("event_type")
    return t.event.groupBy((F.col("user_id") % 10).alias("stage")).agg(
        F.count(F.when(kind == "signup", 1)).alias("planned"), F.count(F.when(kind.isin("view", "click"), 1)).alias("published"), F.count(F.when(kind == "error", 1)).alias("failed"), F.max("event_id").alias("last_pass")
    )
