"""File sources and sinks: traces, logs, version-control dumps, snapshots."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.identity import redacted

SPAN = "traceId string, spanId string, parentSpanId string, name string, startTimeUnixNano string, endTimeUnixNano string, attributes map<string,string>, failed boolean"
#: A log entry as every source gives it.
LOG = {
    "id": "string", "at": "long", "level": "string", "source": "string", "run": "string", "unit": "string", "message": "string", "code": "string", "arguments": "map<string,string>", "quoted": "boolean",
    "file": "string", "line": "long", "path": "string", "detail": "string", "cut": "boolean", "fields": "map<string,string>",
}
MAX_DETAIL = 20_000
SECRET = ("token", "secret", "password", "apikey", "authorization", "cookie")


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Spans of JSON lines with a fixed schema; a bad line fails the read."""
    return spans_of(spark.read.schema(SPAN).option("mode", "FAILFAST").json(path))


def spans_of(rows: DataFrame) -> DataFrame:
    ms = lambda c: F.col(c).cast("decimal(38,0)") / 1_000_000
    return rows.select("traceId", "spanId", "parentSpanId", "name", ms("startTimeUnixNano").cast("double").alias("start"), ms("endTimeUnixNano").cast("double").alias("end"), "attributes", F.coalesce("failed", F.lit(False)).alias("failed"))


def logs(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Several log folders as one row shape; what a source lacks is null.

    An entry without an id is named by its source, file and content. One without a code is verbatim text (``quoted``). A
    message that begins with ``file:line:`` gives its place, details are cut at ``MAX_DETAIL`` characters, and fields whose
    names speak of secrets are left out.
    """
    out = None
    schema = ", ".join(f"{n} {t}" for n, t in LOG.items())
    place = r"\A([^ :]+):([0-9]+):"
    for source, path in sorted(paths.items()):
        rows = spark.read.schema(schema).json(path).withColumn("source", F.coalesce("source", F.lit(source)))
        named = F.concat_ws(":", "source", F.col("_metadata.file_name"), F.substring(F.sha1(F.to_json(F.struct(*[F.col(c) for c in LOG if c != "id"]))), 1, 12))
        rows = rows.withColumns({
            "id": F.coalesce("id", named), "quoted": F.coalesce("quoted", F.col("code").isNull()), "cut": F.coalesce("cut", F.length("detail") > MAX_DETAIL, F.lit(False)), "detail": F.substring("detail", 1, MAX_DETAIL),
            "file": F.coalesce("file", F.nullif(F.regexp_extract("message", place, 1), F.lit(""))), "line": F.coalesce("line", F.regexp_extract("message", place, 2).try_cast("long")),
            "fields": redacted(F.col("fields"), SECRET),
        })
        out = rows if out is None else out.unionByName(rows)
    return out.select(*LOG)


def tree(spark: SparkSession, listing: str, counts: str) -> DataFrame:
    """(mode, kind, sha, bytes, path, lines, binary) of the dumps of a tree: its listing, records of ``mode kind sha size``,
    a tab and the path, and line counts against the empty tree, records of added, removed and path, each ended by a zero byte.

    A path counted as ``-`` is binary and has no lines; one without counts has null for both. Links to other repositories
    (kind commit) are kept, without bytes.
    """
    records = lambda path: spark.read.option("lineSep", "\0").text(path).where("value <> ''")
    head, path = F.split(F.regexp_replace(F.substring_index("value", "\t", 1), " +", " "), " "), F.expr("substring(value, instr(value, '\t') + 1)")
    entries = records(listing).select(head[0].alias("mode"), head[1].alias("kind"), head[2].alias("sha"), head[3].try_cast("long").alias("bytes"), path.alias("path"))
    part = F.split("value", "\t", 3)
    counted = records(counts).select(part[2].alias("path"), part[0].try_cast("long").alias("lines"), (part[0] == "-").alias("binary"))
    return entries.join(counted, "path", "left").select("mode", "kind", "sha", "bytes", "path", "lines", "binary")


def change_log(spark: SparkSession, statuses: str, counts: str) -> DataFrame:
    """(hash, author, at, path, status, added, removed) of two dumps of one history.

    Records start with 0x1E; their first line is hash, author and ISO time separated by 0x1F; then lines of tab-separated
    status and path, or added, removed and path. A path without counts (binary, or not in the dump) has nulls.
    """

    def records(path: str) -> DataFrame:
        text = spark.read.option("lineSep", "\x1e").text(path).where(F.trim("value") != "")
        lines = F.split("value", "\n")
        head = F.split(lines[0], "\x1f")
        return text.select(head[0].alias("hash"), head[1].alias("author"), F.to_timestamp(head[2]).alias("at"), F.explode(F.filter(F.slice(lines, 2, F.size(lines)), lambda x: F.trim(x) != "")).alias("line"))

    a = records(statuses).select("hash", "author", "at", F.split("line", "\t")[1].alias("path"), F.split("line", "\t")[0].alias("status"))
    number = lambda i: F.expr(f"try_cast(split(line, '\\t')[{i}] AS BIGINT)")
    b = records(counts).select("hash", F.split("line", "\t")[2].alias("path"), number(0).alias("added"), number(1).alias("removed"))
    return a.join(b, ["hash", "path"], "left")


def publish(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Appends a batch to a folder, partitioned by a column if asked."""
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def next_snapshot(assertions: DataFrame, written: DataFrame, source: str, opened_by: str) -> DataFrame:
    """The assertions after ``store_version``: superseded rows get their recorded end, new rows are appended.

    Files can't be updated in place, so a version writes a new snapshot.
    """
    closed = written.where("action = 'closed'").select("kind", "entity_id", F.col("valid_from"), F.col("recorded_to").alias("__end"))
    keys = ["kind", "entity_id", "valid_from"]
    mine = (F.col("source") == source) & F.col("recorded_to").isNull()
    kept = assertions.join(closed, keys, "left").withColumn("recorded_to", F.when(mine & F.col("__end").isNotNull(), F.col("__end")).otherwise(F.col("recorded_to"))).drop("__end")
    new = written.where("action <> 'closed'").drop("action").withColumns({"source": F.lit(source), "opened_by": F.lit(opened_by)})
    return kept.unionByName(new, allowMissingColumns=True)
