"""Streaming queries: they drain the events as a stream and return what their batch form would."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.plans.writer import VISIT, VISITED
from tessera.streaming import live


@query("stream_progress", "SELECT user_id % 10 AS stage, count(*) FILTER (WHERE event_type = 'signup') AS planned, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS published, count(*) FILTER (WHERE event_type = 'error') AS failed, max(event_id) AS last_pass FROM events GROUP BY 1")
def stream_progress(t):
    return live.run(live.progress(live.source(t.spark, t.sf_dir, "events")), "complete")


@query("stream_windows", "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) // 1000 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING min(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_windows(t):
    rows = live.run(live.windowed(live.source(t.spark, t.sf_dir, "events")))
    return rows.select(F.unix_millis("window.start").alias("start"), "event_type", "n")


@query(
    "stream_meter",
    """SELECT user_id AS session, event_id AS seq, CASE WHEN prev IS NULL OR r < prev THEN r ELSE r - prev END AS increment FROM (SELECT *, lag(r) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS prev
    FROM (SELECT user_id, event_id, ts, CAST(floor(value) AS BIGINT) AS r FROM events) x) y WHERE epoch_us(ts) // 1000 < (SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events)""",
)
def stream_meter(t):
    events = live.source(t.spark, t.sf_dir, "events")
    return live.run(live.meter(events.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.floor("value").alias("reading"), "ts")))


@query("stream_transitions", f"{VISITED} WHERE tick < (SELECT max(tick) - 3600000 FROM event)")
def stream_transitions(t):
    """The visits' steps as a stream takes them: all events that the watermark has passed."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    events = live.source(t.spark, t.sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_id").alias("seq"), F.col("event_type").alias("event"), "ts", "value", k.alias("k"))
    return live.run(live.follow(events, VISIT)).select(F.col("seq").alias("event_id"), "before", "after", "transition", "code", "guard")


@query(
    "stream_store_version",
    """WITH v AS (SELECT CAST(FLOOR(tick / 864000000) AS BIGINT) AS b, user_id AS e, arg_max(event_type, event_id) AS c FROM event GROUP BY 1, 2),
    b AS (SELECT b, lead(b) OVER (ORDER BY b) AS next FROM (SELECT DISTINCT b FROM v) x), e AS (SELECT v.*, b.next, lag(v.b) OVER w AS before, lag(c) OVER w AS was FROM v JOIN b ON b.b = v.b WINDOW w AS (PARTITION BY e ORDER BY v.b)),
    n AS (SELECT e.*, p.b AS previous, CASE WHEN was = c AND before = p.b THEN 0 ELSE 1 END AS new FROM e LEFT JOIN b p ON p.next = e.b), i AS (SELECT *, sum(new) OVER (PARTITION BY e ORDER BY b) AS i FROM n),
    r AS (SELECT g.e, g.c, g.b, b.next AS z FROM (SELECT e, c, i, min(b) AS b, max(b) AS last FROM i GROUP BY e, c, i) g JOIN b ON b.b = g.last)
    SELECT e AS entity_id, c AS content, b * 864000000 AS valid_from, z * 864000000 AS valid_to, 'b' || CAST(coalesce(z, b) AS VARCHAR) AS opened_by, CAST(NULL AS VARCHAR) AS closed_by, coalesce(z, b) * 864000000 + 86400000 AS recorded_from, CAST(NULL AS BIGINT) AS recorded_to FROM r
    UNION ALL SELECT e, c, b * 864000000, NULL, 'b' || CAST(b AS VARCHAR), 'b' || CAST(z AS VARCHAR), b * 864000000 + 86400000, z * 864000000 + 86400000 FROM r WHERE z IS NOT NULL""",
)
def stream_store_version(t):
    """Ten days of events each make a version, users with their last event; they come as a stream and are stored in turn."""
    ten = F.floor(F.col("tick") / 864_000_000)
    last = t.event.groupBy(ten.alias("b"), F.col("user_id").alias("entity_id")).agg(F.max_by("event_type", "event_id").alias("content"))
    at = (F.col("b") * 864_000_000).cast("long")
    rows = last.select(F.lit("src").alias("source"), F.concat(F.lit("b"), F.col("b").cast("string")).alias("commit_id"), at.alias("committed_at"), (at + 86_400_000).alias("recorded_at"), F.lit("user").alias("kind"), "entity_id", "content")
    path = live._shared(t.spark)
    rows.coalesce(1).write.parquet(f"{path}/versions")
    out = live.store_versions(t.spark.readStream.schema(live.VERSION).parquet(f"{path}/versions"))
    return out.drop("source", "kind")
