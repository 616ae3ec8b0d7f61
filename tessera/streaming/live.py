"""Structured Streaming forms of the progress fold, the usage meter and windowed counts.

Each equals its batch form over the rows that its watermark has passed. ``run`` drains what is available and returns the
sink's content.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lineage import cut
from tessera.operators import temporal
from tessera.operators.machines import Machine
from tessera.sources.files import SPAN, spans_of


def _shared(spark: SparkSession) -> str:
    cut(spark.range(1))  # makes sure that a checkpoint folder is set
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{path.rstrip('/')}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern: file or folder alike


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drains the stream into files. Complete mode rewrites the result per batch, under a name of its own."""
    spark = stream.sparkSession
    at = _shared(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        writer.outputMode("append").format("parquet").option("path", f"{at}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")
    last: list[int] = []

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/out/{batch}")
        last.append(batch)

    writer.outputMode(mode).foreachBatch(save).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out/{last[-1]}") if last else spark.createDataFrame([], stream.schema)


def progress(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.groupBy((F.col("user_id") % 10).alias("stage")).agg(
        F.count(F.when(kind == "signup", 1)).alias("planned"), F.count(F.when(kind.isin("view", "click"), 1)).alias("published"),
        F.count(F.when(kind == "error", 1)).alias("failed"), F.max("event_id").alias("last_pass"),
    )


def trace_source(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Spans of JSON lines files as they arrive, each file read once; a bad line fails the read, as in ``files.traces``."""
    rows = spark.readStream.schema(SPAN).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_trigger).json(path)
    return spans_of(rows)


def windowed(events: DataFrame, late: str = "1 hour", width: str = "6 hours") -> DataFrame:
    """Events per window and type, for append mode: a window is final, and leaves the state, once the watermark (the newest
    time less ``late``) has passed its end; rows that come later still are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def meter(readings: DataFrame, late: str = "1 hour") -> DataFrame:
    """(session, seq, increment) of a cumulative reading per session; ``readings``: session, seq, reading, ts.

    Rows may come in any order within ``late`` of the newest time, over any number of micro-batches: they wait in the state
    until the watermark has passed them, and are then taken in the order of (ts, seq). The state is the last reading and the
    waiting rows; it is visited again when the watermark passes the first of these. Rows later than that are dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, ticks, seqs, values = state.get if state.exists else (None, [], [], [])
        waiting = list(zip(ticks, seqs, values))
        if not state.hasTimedOut:
            for f in frames:
                waiting += zip((f["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist(), f["seq"].tolist(), f["reading"].tolist())
        waiting.sort()
        passed = state.getCurrentWatermarkMs()
        n = sum(t < passed for t, _, _ in waiting)
        out = []
        for _, seq, reading in waiting[:n]:
            out.append((key[0], seq, reading if last is None or reading < last else reading - last))
            last = reading
        left = waiting[n:]
        state.update((last, *(list(x) for x in zip(*left))) if left else (last, [], [], []))
        if left:
            state.setTimeoutTimestamp(max(left[0][0], passed + 1))
        yield pd.DataFrame(out, columns=["session", "seq", "increment"])

    timed = readings.select("session", "seq", "reading", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    held = "last long, ticks array<long>, seqs array<long>, readings array<long>"
    return timed.groupBy("session").applyInPandasWithState(step, "session long, seq long, increment long", held, "append", "EventTimeTimeout")


def follow(events: DataFrame, machine: Machine, late: str = "1 hour") -> DataFrame:
    """(subject, seq, before, after, transition, code, guard): ``machines.follow`` over a stream of (subject, seq, event, ts) and
    the columns that the guards read.

    Rows may come in any order within ``late`` of the newest time; they wait in the state until the watermark has passed them,
    and are then taken by (ts, seq). The state is the machine's state and the waiting rows.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, ticks, seqs, kinds, helds = state.get if state.exists else (machine.initial, [], [], [], [])
        waiting = list(zip(ticks, seqs, kinds, helds))
        if not state.hasTimedOut:
            for f in frames:
                waiting += zip((f["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist(), f["seq"].tolist(), f["event"].tolist(), f["held"].tolist())
        waiting.sort(key=lambda w: w[:2])
        passed = state.getCurrentWatermarkMs()
        n = sum(w[0] < passed for w in waiting)
        out = []
        for _, seq, event, held in waiting[:n]:
            after, *more = machine.step(now, event, frozenset(held.split(",")))
            out.append((key[0], seq, now, after, *more))
            now = after
        left = waiting[n:]
        state.update((now, *(list(x) for x in zip(*left))) if left else (now, [], [], [], []))
        if left:
            state.setTimeoutTimestamp(max(left[0][0], passed + 1))
        yield pd.DataFrame(out, columns=["subject", "seq", "before", "after", "transition", "code", "guard"])

    timed = events.select("subject", "seq", "event", F.array_join(machine.held(), ",").alias("held"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    kept = "now string, ticks array<long>, seqs array<long>, kinds array<string>, helds array<string>"
    out = "subject long, seq long, before string, after string, transition string, code string, guard string"
    return timed.groupBy("subject").applyInPandasWithState(step, out, kept, "append", "EventTimeTimeout")


COMMIT = "source string, commit_id string, committed_at long, digest string"
ASSERTION = "source string, kind string, entity_id long, content string, valid_from long, valid_to long, opened_by string, closed_by string, recorded_from long, recorded_to long"
VERSION = "source string, commit_id string, committed_at long, recorded_at long, kind string, entity_id long, content string"


def snapshot_after(assertions: DataFrame, written: DataFrame, source: str, commit: str) -> DataFrame:
    """The assertions after ``store_version``: what it superseded gets its recorded end and the commit that closed it, what it
    wrote is appended."""
    closed = written.where("action = 'closed'").select("kind", "entity_id", "valid_from", F.col("recorded_to").alias("__end"))
    mine = (F.col("source") == source) & F.col("recorded_to").isNull() & F.col("__end").isNotNull()
    kept = assertions.join(closed, ["kind", "entity_id", "valid_from"], "left").withColumns({"closed_by": F.when(mine, commit).otherwise(F.col("closed_by")), "recorded_to": F.when(mine, F.col("__end")).otherwise(F.col("recorded_to"))})
    new = written.where("action <> 'closed'").withColumns({"source": F.lit(source), "opened_by": F.lit(commit), "closed_by": F.lit(None).cast("string")})
    return kept.select(*assertions.columns).unionByName(new.select(*assertions.columns))


def store_commits(assertions: DataFrame, stored: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assertions, commits, outcomes) after the versions (source, commit_id, committed_at, recorded_at, kind, entity_id, content),
    each the whole model of its source at a commit, in the order in which they were recorded.

    A commit stored before is not stored again, and one that comes with another time or content is refused (``admit``). One that
    comes late, before stored commits of its source, changes what lies between it and the next of them. Commits are few
    against their rows: they are taken one by one, each as a set operation.
    """
    digests = cut(temporal.version_digests(versions).join(versions.groupBy("source", "commit_id").agg(F.min("recorded_at").alias("recorded_at")), ["source", "commit_id"]))
    outcomes = cut(temporal.admit(stored, digests))
    fresh = outcomes.where("outcome = 'stored'").select("source", "commit_id")
    new = digests.join(fresh, ["source", "commit_id"], "left_semi")
    known = {(r["source"], r["committed_at"]) for r in stored.select("source", "committed_at").collect()}
    for c in sorted(new.collect(), key=lambda c: (c["recorded_at"], c["source"], c["committed_at"], c["commit_id"])):
        later = [at for source, at in known if source == c["source"] and at > c["committed_at"]]
        mine = versions.where((F.col("source") == c["source"]) & (F.col("commit_id") == c["commit_id"]))
        written = cut(temporal.store_version(assertions, mine, c["source"], c["committed_at"], c["recorded_at"], min(later, default=None)))
        assertions = cut(snapshot_after(assertions, written, c["source"], c["commit_id"]))
        known.add((c["source"], c["committed_at"]))
    return assertions, stored.unionByName(new.select(*stored.columns)), outcomes


def _at(spark: SparkSession, path: str, batch: int) -> tuple[DataFrame, DataFrame]:
    """Assertions and commits after a micro-batch; none before the first."""
    if batch < 0:
        return spark.createDataFrame([], ASSERTION), spark.createDataFrame([], COMMIT)
    return spark.read.schema(ASSERTION).parquet(f"{path}/{batch}/assertions"), spark.read.schema(COMMIT).parquet(f"{path}/{batch}/commits")


def store_batch(versions: DataFrame, batch: int, path: str) -> None:
    """Stores the commits of a micro-batch on top of the one before.

    What a batch leaves is a function of its rows and of what the last one left, and it is written under the batch's number: a
    batch that comes again writes the same, and a commit that comes again in a later batch is known by then. Each commit's rows
    have to come in one batch; commits may come late.
    """
    assertions, commits = _at(versions.sparkSession, path, batch - 1)
    after, known, outcomes = store_commits(assertions, commits, cut(versions))
    for name, df in (("assertions", after), ("commits", known), ("outcomes", outcomes)):
        df.write.mode("overwrite").parquet(f"{path}/{batch}/{name}")


def store_versions(versions: DataFrame, path: str | None = None) -> DataFrame:
    """The assertions after a stream of model versions (``VERSION``) has been drained, as ``store_commits`` gives them."""
    spark = versions.sparkSession
    path = path or _shared(spark)
    last = [-1]

    def save(df: DataFrame, batch: int) -> None:
        store_batch(df, batch, f"{path}/out")
        last[0] = batch

    versions.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    return _at(spark, f"{path}/out", last[0])[0]
