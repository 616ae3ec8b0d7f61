"""Opinion resolution: agreed and contested values, language choice, refinement, provenance.

Every operator is one aggregation per holder over all fields at once; nothing is correlated per row and field.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OPEN = "open"
LIVE = ("open", "confirmed")


def agreed(field: str) -> Column:
    """The value all rows with a value share, else null. min = max is count(distinct) = 1 without its expansion."""
    return F.when(F.min(field) == F.max(field), F.max(field))


def agree(opinions: DataFrame, holder: str, fields: Sequence[str], state: str = OPEN) -> DataFrame:
    """One row per holder with open opinions: its agreed values."""
    return opinions.where(F.col("state") == state).groupBy(holder).agg(*[agreed(f).alias(f) for f in fields])


def contested(opinions: DataFrame, holder: str, fields: Sequence[str]) -> DataFrame:
    """Holders with disagreement and, comma-joined in field order, the fields concerned."""
    split = [F.when(F.min(f) != F.max(f), F.lit(f)) for f in fields]
    rows = opinions.where(F.col("state") == OPEN).groupBy(holder).agg(F.concat_ws(",", *split).alias("contested"))
    return rows.where(F.col("contested") != "")


def details(opinions: DataFrame, holder: str, fields: Sequence[str], keys: Sequence[str] = (), order: str = "id", most: int = 3) -> DataFrame:
    """(holder, field, is_key, value, contested, opinions, newest): every field of every holder with open opinions.

    A key field is identity: its value stands without opinions. Of the others come the agreed value, the number of opinions
    with a value and the last ``most``, newest first, as ``order=value``.
    """
    rows = opinions.where(F.col("state") == OPEN)
    pairs = ", ".join(f"'{f}', CAST({f} AS STRING)" for f in fields)
    long = rows.select(holder, order, F.expr(f"stack({len(fields)}, {pairs}) AS (field, v)"))
    stated = long.groupBy(holder, "field").agg(agreed("v").alias("value"), (F.coalesce(F.min("v") != F.max("v"), F.lit(False))).alias("contested"), F.count("v").alias("opinions"))
    last = long.where("v IS NOT NULL").withColumn("rn", F.row_number().over(W.partitionBy(holder, "field").orderBy(F.desc(order)))).where(F.col("rn") <= most)
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.concat_ws("=", F.col(order).cast("string"), "v").alias("t")))), lambda x: x["t"]), ",")
    out = stated.join(last.groupBy(holder, "field").agg(shown.alias("newest")), [holder, "field"], "left").withColumn("is_key", F.lit(False))
    out = out.select(holder, "field", "is_key", "value", "contested", "opinions", F.coalesce("newest", F.lit("")).alias("newest"))
    for k in keys:
        held = rows.select(holder, F.lit(k).alias("field"), F.lit(True).alias("is_key"), F.col(k).cast("string").alias("value")).distinct()
        out = out.unionByName(held.select("*", F.lit(False).alias("contested"), F.lit(0).cast("long").alias("opinions"), F.lit("").alias("newest")))
    return out


def choose_language(opinions: DataFrame, holder: str, field: str, lang: str, fallback: str) -> DataFrame:
    """The rows that speak for a text field: those in the reader's language, else in the fallback, else the neutral ones.

    Only rows with a value decide which language is available; a third language is never shown.
    """
    rank = F.when(F.col("lang") == lang, 0).when(F.col("lang") == fallback, 1).when(F.col("lang").isNull(), 2)
    rows = opinions.where((F.col("state") == OPEN) & F.col(field).isNotNull()).withColumn("__rank", rank).where(F.col("__rank").isNotNull())
    return rows.withColumn("__best", F.min("__rank").over(W.partitionBy(holder))).where("__rank = __best").drop("__rank", "__best")


def label_language(opinions: DataFrame, holder: str, field: str, lang: str, fallback: str) -> DataFrame:
    """As ``choose_language``, but where nothing fits any language will do."""
    rank = F.when(F.col("lang") == lang, 0).when(F.col("lang") == fallback, 1).when(F.col("lang").isNull(), 2).otherwise(3)
    rows = opinions.where((F.col("state") == OPEN) & F.col(field).isNotNull()).withColumn("__rank", rank)
    return rows.withColumn("__best", F.min("__rank").over(W.partitionBy(holder))).where("__rank = __best").drop("__rank", "__best")


def newest(rows: DataFrame, by: str, order: Sequence[Column], most: int, rank: str = "rn") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col(rank) <= most)


def refine(opinions: DataFrame, holder: str, field: str, order: Sequence[str]) -> DataFrame:
    """The value of the last declared producer that states one; its own rows must agree with each other."""
    ranks = F.element_at(F.create_map(*[x for i, p in enumerate(order) for x in (F.lit(p), F.lit(i))]), F.col("producer"))
    rows = opinions.where((F.col("state") == OPEN) & F.col(field).isNotNull() & F.col("producer").isin(*order)).withColumn("__rank", ranks)
    per = rows.groupBy(holder, "__rank").agg(agreed(field).alias(field))
    return per.groupBy(holder).agg(F.max_by(field, "__rank").alias(field))


def undeclared(opinions: DataFrame, holder: str, field: str) -> DataFrame:
    """Without a declared order: the agreed value, or all distinct values, sorted and joined."""
    rows = opinions.where((F.col("state") == OPEN) & F.col(field).isNotNull())
    return rows.groupBy(holder).agg(F.array_join(F.array_sort(F.collect_set(field)), "|").alias(field))
