"""Rendezvous (highest-random-weight) sharding in DataFrame functions only.

Every (key, shard) pair gets a uniform number u from a 64-bit hash; a row goes to the shard with the largest
``weight / -ln(u)``. The choice depends on the key and the shard list alone, so one more shard only takes rows
into itself, and no state or shuffle is needed to place a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rendezvous(key: Column, weights: Sequence[float], seed: str = "shard") -> Column:
    """Shard number 0..n-1 for a key. Shards of weight 0 get no rows; ties go to the lower number.

    A null key is a key like any other (all null keys share a shard).
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must hold a positive number and no negative one")

    def cost(i: int, w: float) -> Column:
        # (53 bits + 0.5) / 2^53 lies strictly between 0 and 1
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(i), key), 11) + F.lit(0.5)) / F.lit(float(2**53))
        return F.struct((-F.log(u) / F.lit(float(w))).alias("c"), F.lit(i).alias("i"))

    costs = [cost(i, w) for i, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*costs))["i"]


def assign_shards(
    df: DataFrame,
    key: str,
    weights: Sequence[float],
    order: Sequence[str] = (),
    shard_col: str = "shard",
    slot_col: str = "slot",
    grown_col: str | None = None,
    grown_weight: float = 1.0,
    blocks: int = 1024,
) -> DataFrame:
    """Adds the shard, a gapless slot number within the shard and, if asked, the shard after one more is added.

    Slots are numbered in two levels: a row's rank inside (shard, block) plus the rows of the shard's earlier blocks.
    A row's block follows from its key and the columns of ``order``. The offsets table has at most
    ``len(weights) * blocks`` rows whatever the input, so it is broadcast; no task holds a whole shard. Repeated keys
    share the shard and get different slots. Nulls: a null key is one key. Empty input gives empty output. Existing
    columns named like the new ones are replaced.
    """
    new = [c for c in (shard_col, slot_col, grown_col) if c]
    base = df.drop(*new)
    block = "__block"
    while block in base.columns:
        block += "_"
    shard = rendezvous(F.col(key), weights)
    # xxhash64 with another seed than the placement, else blocks and shards correlate; with the order's columns, so that
    # the rows of one frequent key are spread over the blocks
    where = F.pmod(F.xxhash64(F.lit("block"), F.col(key), *order), F.lit(blocks)).cast("int")
    placed = base.withColumns({shard_col: shard, block: where})
    if grown_col:
        placed = placed.withColumn(grown_col, rendezvous(F.col(key), [*weights, grown_weight]))
    counts = (
        base.select(shard.alias("s"), where.alias("b"))
        .groupBy("s", "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("off", F.sum("n").over(W.partitionBy("s").orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n"))
        .select(F.col("s").alias("__s"), F.col("b").alias("__b"), F.col("off").alias("__off"))
    )
    rank = F.row_number().over(W.partitionBy(shard_col, block).orderBy(*[F.col(c) for c in (key, *order)]))
    # at most len(weights) * blocks rows of three numbers
    joined = placed.withColumn("__rank", rank).join(
        F.broadcast(counts), (F.col(shard_col) == F.col("__s")) & (F.col(block) == F.col("__b")), "left"
    )
    return joined.withColumn(slot_col, (F.col("__off") + F.col("__rank") - 1).cast("long")).drop(block, "__s", "__b", "__off", "__rank")


def shard_documents(docs: DataFrame, shards: int = 16, weights: Sequence[float] | None = None) -> DataFrame:
    """Documents by ``doc_id`` over shards: size, text crc32, shard, slot and the shard under one more shard.

    Null text: size 1 and the crc32 of no bytes (0). Equal ids (with whatever text) share the shard.
    """
    slim = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = assign_shards(slim, "doc_id", weights or [1.0] * shards, order=("size", "text_crc32"), grown_col="grown_shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
