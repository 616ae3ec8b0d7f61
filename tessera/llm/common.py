"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UTC = "UTC"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the setting is absent and the master local, as in tests, a local folder is used.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        path = tempfile.mkdtemp(dir="/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write a (narrow) table to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts; one pass, one number to the driver."""
    return docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def join_counted(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", share: int = 1000) -> DataFrame:
    """Joins ``left`` with ``right``, which has one row a key and in ``many`` the number of left rows with that key.

    Keys with over 1/``share`` of all left rows, of which there are fewer than ``share`` whatever the input, are joined by
    broadcast, so that no task gets all rows of a hot key; the rest is an ordinary join. Both sides should be tables that
    are cheap to read twice. Left rows of a null key are joined with nothing. ``how`` is inner or left.
    """
    on = [on] if isinstance(on, str) else on
    total, most = right.agg(F.sum("many"), F.max("many")).first()
    if not total or most * share <= total:
        return left.join(right.drop("many"), on, how)
    hot = F.col("many") * share > total
    few = right.where(hot).drop("many")  # fewer than ``share`` rows
    rest = left.join(F.broadcast(few.select(on)), on, "left_anti").join(right.where(~hot).drop("many"), on, how)
    return left.join(F.broadcast(few), on).unionByName(rest)


def among(df: DataFrame, key: str, ids: DataFrame, how: str = "left_semi", most: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (one column, distinct; ``how`` left_anti: whose key isn't).

    Up to ``most`` ids are broadcast, so that only the rows they name are shuffled later; of more, both sides are shuffled.
    """
    named = ids.toDF("__among")
    if named.limit(most + 1).count() <= most:
        named = F.broadcast(named)
    return df.join(named, df[key] == named["__among"], how)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet (names compare case-insensitively)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte buffer and n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    kind = np.int64 if large else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind, count=n + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0]: offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that what is made of them is small at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def spans(offsets: np.ndarray, most: int):
    """Consecutive documents of at most ``most`` bytes together (one longer document alone), as index pairs."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
