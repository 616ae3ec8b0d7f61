"""Trace, usage and log analytics: interval unions, self time, gaps, meters, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.ranges import dealt, running


def islands(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end, before) of the merged intervals per key; touching ones merge, empty ones are dropped. ``before`` is the
    end of the key's island before, null for the first.

    An interval begins an island if it starts after all earlier ones of its key have ended. The latest end so far and the
    island's start are carried over ranges, so that no key is one task's.
    """
    order = [F.col(start), F.col(end)]
    some = dealt(rows.where(F.col(start) < F.col(end)).select(key, start, end), key, order)
    seen = running(some, key, order, "__seen", F.col(end), own=False)
    begins = F.col("__seen").isNull() | (F.col(start) > F.col("__seen"))
    marked = seen.withColumn("__begin", F.when(begins, F.col(start)))
    # starts only grow, so the newest beginning is the largest
    placed = running(marked, key, order, "__island", F.col("__begin"))
    return placed.groupBy(key, "__island").agg(F.max(end).alias("__end"), F.max(F.when(F.col("__begin").isNotNull(), F.col("__seen"))).alias("before")).select(key, F.col("__island").alias("start"), F.col("__end").alias("end"), "before")


def covered(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    return islands(rows, key, start, end).groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def uncovered(spans: DataFrame) -> DataFrame:
    """(trace, gap_start, gap_end): what no span of a trace covers, between its first start and its last end.

    The run's own span, the one root (without a parent in the trace) that begins with the first root and ends with the last,
    covers everything by construction and doesn't count; a trace without such a span is covered by all its spans.
    """
    known = spans.select("trace", F.col("span").alias("parent"), F.lit(True).alias("known"))
    marked = spans.join(known, ["trace", "parent"], "left").withColumn("root", F.col("known").isNull())
    ends = marked.groupBy("trace").agg(
        F.min("started").alias("begin"), F.max("ended").alias("end"),
        F.min(F.when(F.col("root"), F.col("started"))).alias("first"), F.max(F.when(F.col("root"), F.col("ended"))).alias("last"),
    )
    placed = marked.join(ends, "trace")
    whole = placed.where("root AND started = first AND ended = last").groupBy("trace").agg(F.min("span").alias("run"))
    others = placed.join(whole, "trace", "left").where("run IS NULL OR span <> run")
    merged = islands(others.select("trace", "started", "ended"), "trace", "started", "ended")
    bounds = ends.select("trace", "begin", F.col("end").alias("finish"))
    inner = merged.join(bounds, "trace").select("trace", F.coalesce("before", "begin").alias("gap_start"), F.col("start").alias("gap_end"))
    tail = bounds.join(merged.groupBy("trace").agg(F.max("end").alias("covered")), "trace", "left").select("trace", F.coalesce("covered", "begin").alias("gap_start"), F.col("finish").alias("gap_end"))
    return inner.unionByName(tail).where("gap_end > gap_start")


def slow_requests(spans: DataFrame, name: str, over: int, depth: int = 8) -> DataFrame:
    """(span, ms, stages, stage_ms, slowest): requests of a name that took ``over`` or longer, with all their descendants, at
    most ``depth`` levels down: their number, the time of the direct ones, and the longest one's name."""
    slow = spans.where((F.col("name") == name) & (F.col("ended") - F.col("started") >= over))
    kids = spans.where("parent IS NOT NULL AND parent <> span").select(F.col("parent").alias("at"), F.col("span").alias("kid"), F.col("name").alias("stage"), (F.col("ended") - F.col("started")).alias("ms"))
    front, found = slow.select("span", F.col("span").alias("at")), None
    for level in range(1, depth + 1):
        front = front.join(kids, "at").select("span", F.col("kid").alias("at"), "stage", "ms", F.lit(level).alias("level"))
        found = front if found is None else found.unionByName(front)
        front = front.select("span", "at")
    stages = found.groupBy("span").agg(
        F.count(F.lit(1)).alias("stages"), F.sum(F.when(F.col("level") == 1, F.col("ms"))).alias("stage_ms"), F.max(F.struct("ms", "stage"))["stage"].alias("slowest")
    )
    zero = F.lit(0).cast("long")
    rows = slow.select("span", (F.col("ended") - F.col("started")).alias("ms")).join(stages, "span", "left")
    return rows.select("span", "ms", F.coalesce("stages", zero).alias("stages"), F.coalesce("stage_ms", zero).alias("stage_ms"), "slowest")


def span_usage(spans: DataFrame) -> DataFrame:
    """(kind, field, model, input, output, total, turns, cost): model calls as spans named agent.usage state them in their
    attributes, one turn's increment each. ``total`` adds the larger of a span's own total and its parts; ``cost`` is a list
    of currency=amount, rounded to 6 places."""
    text = lambda key: F.coalesce(F.try_element_at("attributes", F.lit(key)), F.lit(""))
    number = lambda key: F.coalesce(F.try_element_at("attributes", F.lit(key)).try_cast("double"), F.lit(0.0))
    calls = spans.where("name = 'agent.usage'").select(
        text("agent.kind").alias("kind"), text("agent.field").alias("field"), text("agent.model").alias("model"),
        number("agent.tokens.input").alias("input"), number("agent.tokens.output").alias("output"), number("agent.tokens.total").alias("said"),
        F.map_filter("attributes", lambda k, v: F.startswith(k, F.lit("agent.cost.")) & v.try_cast("double").isNotNull()).alias("costs"),
    )
    key = ["kind", "field", "model"]
    tokens = calls.groupBy(*key).agg(
        F.sum("input").cast("long").alias("input"), F.sum("output").cast("long").alias("output"),
        F.sum(F.greatest("said", F.col("input") + F.col("output"))).cast("long").alias("total"), F.count(F.lit(1)).alias("turns"),
    )
    money = calls.select(*key, F.explode("costs").alias("name", "amount")).groupBy(*key, "name").agg(F.sum(F.col("amount").cast("decimal(20,6)")).alias("amount"))
    line = F.concat(F.substring("name", len("agent.cost.") + 1, 100), F.lit("="), F.round("amount", 6).cast("double").cast("string"))
    listed = money.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(line)), ";").alias("cost"))
    return tokens.join(listed, key, "left").withColumn("cost", F.coalesce("cost", F.lit("")))


def message_codes(log: DataFrame, families: Sequence[tuple[str, str, Sequence[str]]]) -> DataFrame:
    """``log`` with ``code`` and ``arguments`` of the first family whose pattern the whole message matches: the engine's own
    events. Other messages have no code and stand as they are (``quoted``)."""
    m = F.col("message")
    code = F.coalesce(*[F.when(m.rlike(f"\\A(?:{p})\\z"), name) for name, p, _ in families])
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    arguments = none
    for name, p, names in reversed(families):
        held = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.regexp_extract(m, p, i + 1))]) if names else none
        arguments = F.when(F.col("code") == name, held).otherwise(arguments)
    return log.withColumn("code", code).withColumn("arguments", arguments).withColumn("quoted", F.col("code").isNull())


def self_times(spans: DataFrame) -> DataFrame:
    """(span, name, self): duration less the union of the children's intervals, not below 0; children aren't clipped."""
    kids = covered(spans.where("parent IS NOT NULL").select("parent", "started", "ended"), "parent", "started", "ended")
    rows = spans.join(kids.select(F.col("parent").alias("span"), "covered"), "span", "left")
    return rows.select("span", "name", F.greatest(F.lit(0), F.col("ended") - F.col("started") - F.coalesce("covered", F.lit(0))).alias("self"))


def attribute(spans: DataFrame, naming: DataFrame, depth: int) -> DataFrame:
    """(span, step): the nearest ancestor or the span itself that names a step, at most ``depth`` levels up."""
    up = spans.select(F.col("span").alias("at"), F.col("parent").alias("up"))
    names = naming.select(F.col("span").alias("at"), F.col("step").alias("s"))
    rows = spans.select("span", F.col("span").alias("at"), F.lit(None).cast("string").alias("step"))
    for level in range(depth + 1):
        rows = rows.join(names, "at", "left").withColumn("step", F.coalesce("step", "s")).drop("s")
        if level < depth:
            rows = rows.join(up, "at", "left").select("span", F.when(F.col("step").isNull(), F.col("up")).alias("at"), "step")
    return rows.select("span", "step")


def increments(readings: DataFrame, session: str, order: str, reading: str) -> DataFrame:
    """A cumulative meter as increments: a drop is a restart, where the reading itself is the increment."""
    last = F.lag(reading).over(W.partitionBy(session).orderBy(order))
    step = F.when(last.isNull() | (F.col(reading) < last), F.col(reading)).otherwise(F.col(reading) - last)
    return readings.withColumn("increment", step)


def first_crossing(rows: DataFrame, session: str, order: str, value: str, bound: int) -> DataFrame:
    """(session, order, total) of the first row at which the running total reaches the bound."""
    total = F.sum(value).over(W.partitionBy(session).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("total", total).where(F.col("total") >= bound).groupBy(session).agg(F.min(F.struct(order, "total")).alias("m")).select(session, f"m.{order}", "m.total")


LEVELS = ("debug", "info", "warn", "error")


def log_page(entries: DataFrame, limit: int = 200, least: str = "debug", sources: Sequence[str] = (), text: str | None = None, after: int | None = None, before: int | None = None) -> DataFrame:
    """The newest entries under the filters, one more for ``more``; entries without a time come last."""
    rank = F.coalesce(*[F.when(F.col("level") == name, i) for i, name in enumerate(LEVELS)])
    rows = entries.where(rank >= LEVELS.index(least))
    rows = rows.where(F.col("source").isin(*sources)) if sources else rows
    rows = rows.where(F.instr(F.lower("message"), text.lower()) > 0) if text else rows
    rows = rows.where(F.col("tick") > after) if after is not None else rows
    rows = rows.where(F.col("tick") < before) if before is not None else rows
    return rows.orderBy(F.desc_nulls_last("tick"), F.desc("id")).limit(min(max(limit, 1), 1000) + 1)


def retained(files: DataFrame, group: str, at: str, size: str, key: str, now: int, max_age: int, max_runs: int, max_bytes: int) -> DataFrame:
    """What a retention sweep keeps: young enough, among the newest runs, within the bytes; oldest go first."""
    young = files.where(F.col(at) >= now - max_age)
    by = W.partitionBy(group).orderBy(F.desc(at), F.desc(key))
    ranked = young.withColumns({"rn": F.row_number().over(by), "used": F.sum(size).over(by.rowsBetween(W.unboundedPreceding, W.currentRow))})
    return ranked.where((F.col("rn") <= max_runs) & (F.col("used") <= max_bytes)).drop("rn", "used")
