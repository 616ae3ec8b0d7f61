"""Per-parent connections with totals, top-k and look-ahead."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.lineage import spread


def connection(rows: DataFrame, parent: str, order: Sequence[Column], first: int, condition: Column | None = None) -> DataFrame:
    """Each parent's first rows, one more for look-ahead, with the parent's total before paging."""
    return grouped_top(rows.where(condition) if condition is not None else rows, [parent], order, first + 1)


def grouped_top(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """Each group's first ``most`` rows with its ``total`` and their rank ``rn``.

    The rank stands alone under its filter, so that each task keeps only ``most`` rows a group before the exchange; totals
    are an aggregate, combined on the map side, and joined to what is left. A hub's rows are never sorted in one task.
    """
    top = rows.withColumn("rn", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("rn") <= most)
    total = rows.groupBy(*[F.col(g).alias(f"__{g}") for g in groups]).agg(F.count(F.lit(1)).alias("total"))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]
    return top.join(total, same).select(*rows.columns, "total", "rn")


def combined_top(rows: DataFrame, groups: Sequence[str], order: str, most: int, tasks: int = 0) -> DataFrame:
    """As ``grouped_top`` by one column ascending, for rows that are dear to compute: they are computed and sent once.

    Of a batch at most ``most`` rows of a group are handed on, the first of them with the number that it stands for, so that no
    group meets whole; what is left is ranked and added up, over ``tasks`` tasks by the first group column if these are more than
    a shuffle has.
    """
    kept = rows.select(*groups, order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    kept = kept.mapInArrow(_firsts(len(groups), most), f"{kinds}, many long")
    place = W.partitionBy(*groups).orderBy(order)
    whole = place.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = spread(kept, tasks, groups[0]).select(*groups, order, F.sum("many").over(whole).alias("total"), F.row_number().over(place).alias("rn"))
    return ranked.where(F.col("rn") <= most)


def _firsts(groups: int, most: int):
    """The first rows of each group of a batch, by the column after the ``groups`` columns, nulls first, and how many rows the
    group has there (0 but for its first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes = [b.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for i in range(groups)]
            rank = pc.rank(b.column(groups), "ascending", null_placement="at_start", tiebreaker="first").to_numpy()
            sort = np.lexsort([rank, *codes])
            starts = np.ones(len(sort), bool)
            starts[1:] = np.logical_or.reduce([np.diff(c[sort]) != 0 for c in codes])
            at = np.flatnonzero(starts)
            sizes = np.diff(at, append=len(sort))
            place, sizes = np.arange(len(sort)) - np.repeat(at, sizes), np.repeat(sizes, sizes)
            kept = place < most
            first = b.take(pa.array(sort[kept]))
            yield pa.RecordBatch.from_arrays([*first.columns, pa.array(np.where(place == 0, sizes, 0)[kept], pa.int64())], names=[*b.schema.names, "many"])

    return run
