"""Trace, usage and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import telemetry as T
from tessera.plans.registry import query

ISLANDS = """m AS (SELECT trace, started, ended, CASE WHEN started > max(ended) OVER (PARTITION BY trace ORDER BY started, ended ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM span WHERE started < ended AND parent IS NOT NULL),
    i AS (SELECT *, sum(new) OVER (PARTITION BY trace ORDER BY started, ended ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m), u AS (SELECT trace, min(started) AS s, max(ended) AS e FROM i GROUP BY trace, island)"""


@query("interval_union", f"WITH {ISLANDS} SELECT trace, s AS start, e AS \"end\" FROM u")
def interval_union(t):
    return T.islands(t.span.where("parent IS NOT NULL"), "trace", "started", "ended").drop("before")


@query("coverage", f"WITH {ISLANDS} SELECT trace, CAST(sum(e - s) AS BIGINT) AS covered FROM u GROUP BY trace")
def coverage(t):
    return T.covered(t.span.where("parent IS NOT NULL"), "trace", "started", "ended")


@query(
    "uncovered_gaps",
    """WITH s AS (SELECT span, parent, span // 10 AS trace, started, ended FROM span), r AS (SELECT s.*, NOT EXISTS (SELECT 1 FROM s p WHERE p.trace = s.trace AND p.span = s.parent) AS root FROM s),
    run AS (SELECT trace, min(span) AS run FROM (SELECT r.*, min(started) FILTER (WHERE root) OVER (PARTITION BY trace) AS a, max(ended) FILTER (WHERE root) OVER (PARTITION BY trace) AS z FROM r) x WHERE root AND started = a AND ended = z GROUP BY trace),
    c AS (SELECT r.* FROM r LEFT JOIN run ON run.trace = r.trace WHERE (run.run IS NULL OR r.span <> run.run) AND r.started < r.ended),
    p AS (SELECT trace, started AS mark FROM c UNION SELECT trace, ended FROM c UNION SELECT trace, min(started) FROM s GROUP BY trace UNION SELECT trace, max(ended) FROM s GROUP BY trace),
    e AS (SELECT trace, mark, lead(mark) OVER (PARTITION BY trace ORDER BY mark) AS upto FROM p), f AS (SELECT e.*, NOT EXISTS (SELECT 1 FROM c WHERE c.trace = e.trace AND c.started <= e.mark AND c.ended >= e.upto) AS open FROM e WHERE upto IS NOT NULL),
    g AS (SELECT *, sum(CASE WHEN open THEN 0 ELSE 1 END) OVER (PARTITION BY trace ORDER BY mark) AS n FROM f)
    SELECT trace, min(mark) AS gap_start, max(upto) AS gap_end FROM g WHERE open GROUP BY trace, n ORDER BY gap_end - gap_start DESC, trace, gap_start LIMIT 10""",
)
def uncovered_gaps(t):
    rows = T.uncovered(t.span.withColumn("trace", F.floor(F.col("span") / 10)))
    return rows.orderBy(F.desc(F.col("gap_end") - F.col("gap_start")), "trace", "gap_start").limit(10)


SELF = """m AS (SELECT parent, started, ended, CASE WHEN started > max(ended) OVER (PARTITION BY parent ORDER BY started, ended ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM span WHERE started < ended AND parent IS NOT NULL),
    i AS (SELECT *, sum(new) OVER (PARTITION BY parent ORDER BY started, ended ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m),
    c AS (SELECT parent, sum(e - s) AS covered FROM (SELECT parent, min(started) AS s, max(ended) AS e FROM i GROUP BY parent, island) x GROUP BY parent),
    f AS (SELECT s.span, s.name, CAST(greatest(0, s.ended - s.started - coalesce(c.covered, 0)) AS BIGINT) AS self FROM span s LEFT JOIN c ON c.parent = s.span)"""


@query("self_time", f"WITH {SELF} SELECT * FROM f")
def self_time(t):
    return T.self_times(t.span)


@query("self_time_by_name", f"WITH {SELF} SELECT name, CAST(sum(self) AS BIGINT) AS self, count(*) AS spans, round(sum(self) * 100.0 / (SELECT max(ended) - min(started) FROM span), 4) AS share FROM f GROUP BY name ORDER BY self DESC, name LIMIT 20")
def self_time_by_name(t):
    wall = t.span.agg((F.max("ended") - F.min("started")).alias("wall"))  # one row
    rows = T.self_times(t.span).groupBy("name").agg(F.sum("self").alias("self"), F.count(F.lit(1)).alias("spans")).crossJoin(wall)
    return rows.select("name", "self", "spans", F.round(F.col("self") * 100.0 / F.col("wall"), 4).alias("share")).orderBy(F.desc("self"), "name").limit(20)


@query("slowest_spans", "SELECT span, name, ended - started AS ms FROM span ORDER BY ms DESC, span LIMIT 10")
def slowest_spans(t):
    return t.span.select("span", "name", (F.col("ended") - F.col("started")).alias("ms")).orderBy(F.desc("ms"), "span").limit(10)


@query("memory_growth", "SELECT span, memory - prev AS growth FROM (SELECT span, memory, lag(memory) OVER (PARTITION BY trace ORDER BY started, span) AS prev FROM span) x WHERE prev IS NOT NULL ORDER BY growth DESC, span LIMIT 10")
def memory_growth(t):
    from pyspark.sql import Window as W

    rows = t.span.select("span", (F.col("memory") - F.lag("memory").over(W.partitionBy("trace").orderBy("started", "span"))).alias("growth"))
    return rows.where("growth IS NOT NULL").orderBy(F.desc("growth"), "span").limit(10)


@query("step_attribution", """WITH n AS (SELECT span, 'step ' || name AS step FROM span WHERE name IN ('signup', 'purchase')), p AS (SELECT s.span, s.parent AS p1, a.parent AS p2, b.parent AS p3 FROM span s LEFT JOIN span a ON a.span = s.parent LEFT JOIN span b ON b.span = a.parent)
    SELECT p.span, coalesce(n0.step, n1.step, n2.step, n3.step) AS step FROM p LEFT JOIN n n0 ON n0.span = p.span LEFT JOIN n n1 ON n1.span = p.p1 LEFT JOIN n n2 ON n2.span = p.p2 LEFT JOIN n n3 ON n3.span = p.p3""")
def step_attribution(t):
    naming = t.span.where("name IN ('signup', 'purchase')").select("span", F.concat(F.lit("step "), "name").alias("step"))
    return T.attribute(t.span, naming, 3)


@query(
    "slow_requests",
    """WITH RECURSIVE d AS (SELECT r.span AS request, c.span, c.name, c.ended - c.started AS ms, 1 AS level FROM span r JOIN span c ON c.parent = r.span AND c.span <> r.span WHERE r.name = 'view' AND r.ended - r.started >= 60
      UNION ALL SELECT d.request, c.span, c.name, c.ended - c.started, d.level + 1 FROM d JOIN span c ON c.parent = d.span AND c.span <> d.span)
    SELECT s.span, s.ended - s.started AS ms, count(d.span) AS stages, CAST(coalesce(sum(d.ms) FILTER (WHERE d.level = 1), 0) AS BIGINT) AS stage_ms, max(struct_pack(ms := d.ms, name := d.name)).name AS slowest
    FROM span s LEFT JOIN d ON d.request = s.span WHERE s.name = 'view' AND s.ended - s.started >= 60 GROUP BY 1, 2""",
)
def slow_requests(t):
    return T.slow_requests(t.span, "view", 60, 4)


@query(
    "usage_from_spans",
    """SELECT event_type AS kind, '' AS field, 'm' || CAST(k % 3 AS VARCHAR) AS model, CAST(sum(k) AS BIGINT) AS input, CAST(sum(user_id % 7) AS BIGINT) AS output, CAST(sum(greatest(CASE WHEN k % 2 = 0 THEN k + 3 ELSE 0 END, k + user_id % 7)) AS BIGINT) AS total, count(*) AS turns,
    concat_ws(';', 'EUR=' || CAST(CAST(round(sum(k) FILTER (WHERE k % 2 = 0) * 0.25, 6) AS DOUBLE) AS VARCHAR), 'USD=' || CAST(CAST(round(sum(k) FILTER (WHERE k % 2 <> 0) * 0.5, 6) AS DOUBLE) AS VARCHAR)) AS cost
    FROM event GROUP BY 1, 2, 3""",
)
def usage_from_spans(t):
    k, text = F.col("k"), lambda c: c.cast("string")
    even = k % 2 == 0
    attributes = F.create_map(
        F.lit("agent.kind"), F.col("event_type"), F.lit("agent.model"), F.concat(F.lit("m"), text(k % 3)), F.lit("agent.tokens.input"), text(k), F.lit("agent.tokens.output"), text(F.col("user_id") % 7),
        F.lit("agent.tokens.total"), F.when(even, text(k + 3)), F.when(even, "agent.cost.EUR").otherwise("agent.cost.USD"), text(F.when(even, k * 0.25).otherwise(k * 0.5)),
    )
    return T.span_usage(t.event.select(F.lit("agent.usage").alias("name"), attributes.alias("attributes")))


METER = "i AS (SELECT *, CASE WHEN prev IS NULL OR reading < prev THEN reading ELSE reading - prev END AS increment FROM (SELECT *, lag(reading) OVER (PARTITION BY session ORDER BY seq) AS prev FROM usage) x)"


@query("usage_meter", f"WITH {METER} SELECT seq, session, CAST(increment AS BIGINT) AS increment FROM i")
def usage_meter(t):
    return T.increments(t.usage, "session", "seq", "reading").select("seq", "session", "increment")


@query("usage_bound_stop", f"WITH {METER}, r AS (SELECT session, seq, CAST(sum(increment) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM i) SELECT session, min(seq) AS seq, min(total) AS total FROM r WHERE total >= 500 GROUP BY session")
def usage_bound_stop(t):
    return T.first_crossing(T.increments(t.usage, "session", "seq", "reading"), "session", "seq", "increment", 500)


@query("usage_by_kind", f"WITH {METER} SELECT kind, model, CAST(sum(increment) AS BIGINT) AS tokens, count(DISTINCT run) AS runs, CAST(coalesce(sum(cost) FILTER (WHERE currency = 'EUR'), 0) AS BIGINT) AS eur, CAST(coalesce(sum(cost) FILTER (WHERE currency = 'USD'), 0) AS BIGINT) AS usd FROM i GROUP BY kind, model")
def usage_by_kind(t):
    cost = lambda c: F.coalesce(F.sum(F.when(F.col("currency") == c, F.col("cost"))), F.lit(0).cast("long"))
    return T.increments(t.usage, "session", "seq", "reading").groupBy("kind", "model").agg(F.sum("increment").alias("tokens"), F.count_distinct("run").alias("runs"), cost("EUR").alias("eur"), cost("USD").alias("usd"))


@query("newest_runs", "WITH r AS (SELECT kind, run, max(seq) AS last FROM usage GROUP BY kind, run) SELECT kind, run, last, CAST(rn AS INTEGER) AS rn, total > 10 AS more FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY last DESC) AS rn, count(*) OVER (PARTITION BY kind) AS total FROM r) x WHERE rn <= 10")
def newest_runs(t):
    from tessera.operators.connections import grouped_top

    r = t.usage.groupBy("kind", "run").agg(F.max("seq").alias("last"))
    return grouped_top(r, ["kind"], [F.desc("last")], 10).select("kind", "run", "last", "rn", (F.col("total") > 10).alias("more"))


@query("log_page", "SELECT id, tick, level, message FROM log WHERE level IN ('warn', 'error') AND source IN ('view', 'error', 'click') AND position('s' IN lower(message)) > 0 ORDER BY tick DESC NULLS LAST, id DESC LIMIT 201")
def log_page(t):
    return T.log_page(t.log, 200, "warn", ("view", "error", "click"), "S").select("id", "tick", "level", "message")


@query("log_error_place", "SELECT id, regexp_extract(message, '^([^ :]+):([0-9]+):', 1) AS file, CAST(regexp_extract(message, '^([^ :]+):([0-9]+):', 2) AS BIGINT) AS line FROM log WHERE regexp_matches(message, '^([^ :]+):([0-9]+):')")
def log_error_place(t):
    place = r"^([^ :]+):([0-9]+):"
    return t.log.where(F.col("message").rlike(place)).select("id", F.regexp_extract("message", place, 1).alias("file"), F.regexp_extract("message", place, 2).cast("long").alias("line"))


FAMILIES = (("step.done", "step done", ()), ("unit.started", "unit ([0-9]+) started", ("unit",)), ("file.failed", "([^ :]+):([0-9]+): failed", ("file", "line")))


@query(
    "log_families",
    """SELECT CASE WHEN message = 'step done' THEN 'step.done' WHEN regexp_full_match(message, 'unit [0-9]+ started') THEN 'unit.started' WHEN regexp_full_match(message, '[^ :]+:[0-9]+: failed') THEN 'file.failed' END AS code,
    CASE WHEN message LIKE 'unit %' THEN regexp_extract(message, '[0-9]+') END AS unit, CASE WHEN message LIKE '%: failed' THEN split_part(message, ':', 1) END AS file, count(*) AS n FROM log GROUP BY 1, 2, 3""",
)
def log_families(t):
    rows = T.message_codes(t.log, FAMILIES)
    held = lambda name: F.try_element_at("arguments", F.lit(name)).alias(name)
    return rows.groupBy("code", held("unit"), held("file")).agg(F.count(F.lit(1)).alias("n"))


@query("retention_sweep", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER w AS rn, sum(k + 1) OVER (PARTITION BY user_id ORDER BY tick DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM event WHERE tick >= 1704067200000 + 3 * 86400000 WINDOW w AS (PARTITION BY user_id ORDER BY tick DESC, event_id DESC)) x WHERE rn <= 20 AND used <= 600")
def retention_sweep(t):
    files = t.event.withColumn("size", F.col("k") + 1)
    return T.retained(files, "user_id", "tick", "size", "event_id", 1_704_067_200_000 + 30 * 86_400_000, 27 * 86_400_000, 20, 600).select("event_id", "user_id")


@query("usage_totals_grouping", "SELECT kind, model, count(*) AS n, CAST(sum(cost) AS BIGINT) AS cost FROM usage GROUP BY GROUPING SETS ((kind, model), (kind), ())")
def usage_totals_grouping(t):
    return t.usage.groupingSets([["kind", "model"], ["kind"], []], "kind", "model").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))
