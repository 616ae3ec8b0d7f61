"""Counts, groups, histograms and top lists over agreed values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def group_by(rows: DataFrame, field: str, limit: int = 20) -> DataFrame:
    """Groups by size, then value, null last; null is a group."""
    n = rows.groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(min(limit, 20))


def histogram(rows: DataFrame, field: str, bounds: Sequence[float]) -> DataFrame:
    """Rows per bucket (-inf, b0) [b0, b1) .. [bn, inf); nulls count nowhere, empty buckets count 0."""
    cuts = sorted({float(b) for b in bounds if b == b and abs(b) != float("inf")})
    bucket = F.lit(0)
    for i, b in enumerate(cuts):
        bucket = F.when(F.col(field) >= b, i + 1).otherwise(bucket)
    # one conditional sum per bucket: no join, one pass, partial sums on the map side
    value = F.col(field).isNotNull()
    sums = rows.agg(*[F.count(F.when(value & (bucket == i), 1)).alias(f"b{i}") for i in range(len(cuts) + 1)])
    pairs = F.array(*[F.struct(F.lit(i).alias("bucket"), F.col(f"b{i}").alias("n")) for i in range(len(cuts) + 1)])
    return sums.select(F.inline(pairs))


def age_days(rows: DataFrame, at_ms: str, now_ms: int) -> DataFrame:
    return rows.withColumn("age", (F.lit(now_ms) - F.col(at_ms)) / F.lit(float(DAY_MS)))


def top_n(rows: DataFrame, field: str, key: str, n: int) -> DataFrame:
    return rows.where(F.col(field).isNotNull()).orderBy(F.desc(field), F.asc(key)).limit(min(n, 50))
