"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over edges (u, v) with v < u.

    Large: every larger neighbour of a node is hung on the node's smallest neighbour. Small: every smaller one, and
    the node itself. The minimum per node is an aggregate joined back, with hubs apart, so that no task gathers a hub.
    """
    if small:
        near = edges
    else:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("many")).withColumn("m", F.least("m", "u")))
    joined = join_counted(near, least, "u")
    if small:
        hung = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        hung = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another; the component is its smallest node.

    Loops and repeated edges count once, edges with a null end not at all; no edges give no rows. Each round's edges
    are written to the shared folder; only their number and a checksum reach the driver, to see that nothing moved.
    """
    now = (
        edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
        .select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    )
    now, seen = materialize(now), None
    while True:
        check = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(check) == seen:
            break
        seen = tuple(check)
        now = materialize(_stars(materialize(_stars(now, small=False)), small=True))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
