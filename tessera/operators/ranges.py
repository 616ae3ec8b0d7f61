"""Running sums and maxima over groups of any size.

A window over a group is one task. Here rows are dealt by ranges of (group, order); each range scans its part, and what the
earlier ranges of the same group add up to is carried into it. Only groups that more than one range holds have anything to
carry, and a range shares at most its first and its last group with others: two rows a range, whatever the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.lineage import cut

RANGE = "__range"


def dealt(rows: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """``rows`` by ranges of (group, order), with the range's number; written once, so that every scan sees the same ranges."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, F.col(group), *order).withColumn(RANGE, F.spark_partition_id()))


def running(rows: DataFrame, group: str, order: Sequence[Column], name: str, value: Column, how: str = "max", own: bool = True) -> DataFrame:
    """Dealt ``rows`` with the sum, maximum or last value (``how``: sum, max, last) of ``value`` over the rows of the group up to
    each one by ``order``, itself included (``own``) or not.

    Nulls are passed over; before any value, the result is null (of sums 0). Rows that tie by ``order`` are taken in any order.
    """
    of = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    local = of(value).over(W.partitionBy(RANGE, group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if own else -1))
    # what a range adds; the last value in it is that of the largest place
    if how == "last":
        placed = rows.select(RANGE, group, value.alias("__value"), F.row_number().over(W.partitionBy(RANGE, group).orderBy(*order)).alias("__n"))
        whole = placed.groupBy(RANGE, group).agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col("__n"))).alias("__whole"))
    else:
        whole = rows.groupBy(RANGE, group).agg(of(value).alias("__whole"))
    by = W.partitionBy(group).orderBy(RANGE)
    carried = whole.select(
        F.col(RANGE).alias("__r"), F.col(group).alias("__g"), of("__whole").over(by.rowsBetween(W.unboundedPreceding, -1)).alias("__carried"), F.lag(RANGE).over(by).alias("__earlier")
    ).where("__earlier IS NOT NULL")
    # at most one row for each two neighbouring ranges
    joined = rows.withColumn("__local", local).join(F.broadcast(carried.drop("__earlier")), (F.col(RANGE) == F.col("__r")) & F.col(group).eqNullSafe(F.col("__g")), "left")
    if how == "sum":
        zero = F.lit(0)
        both = F.coalesce("__local", zero) + F.coalesce("__carried", zero)
    else:
        both = F.greatest("__local", "__carried") if how == "max" else F.coalesce("__local", "__carried")
    return joined.withColumn(name, both).drop("__local", "__r", "__g", "__carried")
