"""Strongly connected components of an edge list (src, dst).

First, nodes with one way out are drawn into the node where their way ends; those that run in circles are components of
their own, found by pointer doubling in as many rounds as their number has binary digits. The same is done against the edges,
for nodes with one way in. What is left is coloured twice: every node takes the largest of the nodes that lead to it, in an
order that a hash gives, and of those that it leads to. Where both are the same node, the node is of its component; edges
between different pairs of colours go, and the rest is coloured again in another order, about as often as the number of nodes
has binary digits. A colouring takes as many steps as the longest distance in what is left; each step reads every edge once and
holds a row a node. Its joins are sort-merge ones by hint: a table that would just be small enough for a broadcast would go
through the driver once for each of the many joins.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import stored as cut

#: Steps of a search between two looks at whether it goes on.
STEPS = 4


class _Drawn(NamedTuple):
    """What a contraction did: single nodes (id, root), the edges that lead into them, and jumps of 1, 4, 16 ... steps."""

    rooted: DataFrame
    entries: DataFrame
    jumps: list[DataFrame]


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _draw(edges: DataFrame) -> tuple[DataFrame, DataFrame, _Drawn] | None:
    """(edges left, components found, what was drawn) after nodes with one way out went into where their way ends."""
    single = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.max("dst").alias("at")).where("n = 1").select(F.col("src").alias("id"), "at", F.col("src").alias("low"))
    now = cut(single)
    total, reach, jumps = now.count(), 1, []
    if not total:
        return None
    while True:
        jumps.append(now.select("id", "at"))
        for _ in range(2):  # two doublings a round
            far = now.select(F.col("id").alias("at"), F.col("at").alias("far"), F.col("low").alias("lower"))
            now = now.hint("merge").join(far, "at", "left").select("id", F.coalesce("far", "at").alias("at"), F.least("low", "lower").alias("low"), F.col("far").isNotNull().alias("moved"))
        now = cut(now)
        if reach >= total or now.where("moved").isEmpty():
            break
        reach *= 4
    # after as many steps as there are nodes, who still moves is on a circle
    ids = now.select("id")
    circling = now.hint("merge").join(ids.withColumnRenamed("id", "at"), "at", "left_semi")
    circles = cut(now.hint("merge").join(circling.select(F.col("at").alias("id")).distinct(), "id", "left_semi").select("id", F.col("low").alias("component")))
    rooted = cut(now.hint("merge").join(ids.withColumnRenamed("id", "at"), "at", "left_anti").select("id", F.col("at").alias("root")))
    others = edges.hint("merge").join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
    into = others.hint("merge").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    entries = cut(into.hint("merge").join(rooted.select(F.col("id").alias("dst"), "root"), "dst"))
    left = others.hint("merge").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst").unionByName(entries.select("src", F.col("root").alias("dst")))
    return cut(left.where("src <> dst").distinct()), circles, _Drawn(rooted, entries, jumps)


def _undrawn(found: DataFrame, drawn: _Drawn) -> DataFrame:
    """Components of the nodes drawn: one belongs to its root's if it lies on the way of an edge that comes from there."""
    of = lambda name: found.select(F.col("id").alias(name), F.col("component").alias(f"of_{name}"))
    both = drawn.entries.hint("merge").join(of("src"), "src", "left").hint("merge").join(of("root"), "root", "left")
    marks = cut(both.where(F.coalesce("of_src", "src") == F.coalesce("of_root", "root")).select(F.col("dst").alias("id")).distinct())
    if marks.isEmpty():
        return found
    for jump in drawn.jumps:
        for _ in range(3):
            marks = marks.unionByName(marks.hint("merge").join(jump, "id").select(F.col("at").alias("id"))).distinct()
        marks = cut(marks)
    mine = drawn.rooted.hint("merge").join(marks, "id", "left_semi").hint("merge").join(of("root"), "root", "left")
    more = mine.select("id", F.coalesce("of_root", "root").alias("component"))
    # a root that had no component of its own until now
    new = mine.where("of_root IS NULL").select(F.col("root").alias("id"), F.col("root").alias("component")).distinct()
    return cut(found.unionByName(more).unionByName(new))


def _passed(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, mark): the largest mark of the nodes that lead to each node along the edges, itself included; some steps a round."""
    while True:
        further = marks
        for _ in range(STEPS):
            sent = edges.hint("merge").join(further.select(F.col("id").alias("src"), "mark"), "src").select(F.col("dst").alias("id"), "mark")
            further = further.unionByName(sent).groupBy("id").agg(F.max("mark").alias("mark"))
        new = cut(further.hint("merge").join(marks.select("id", F.col("mark").alias("before")), "id"))
        marks = new.select("id", "mark")
        if new.where("mark <> before").isEmpty():
            return marks


def _coloured(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of components of two nodes or more."""
    found, turn = None, 0
    while True:
        for _ in range(STEPS):  # nodes without a way in or out
            starts, stops = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
            edges = edges.hint("merge").join(starts, "dst", "left_semi").hint("merge").join(stops, "src", "left_semi").select("src", "dst")
        edges = cut(edges)
        if edges.isEmpty():
            return found if found is not None else edges.select(F.col("src").alias("id"), F.col("dst").alias("component"))
        # another order of the nodes in every round, so that what is left falls into parts of about half its size
        turn += 1
        marks = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("mark", F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), "id"))
        ahead = _passed(edges, marks).withColumnRenamed("mark", "ahead")
        colour = cut(ahead.hint("merge").join(_passed(_turned(edges), marks).withColumnRenamed("mark", "behind"), "id"))
        some = colour.where("ahead = behind").select("id", F.col("ahead.id").alias("component"))
        found = cut(some if found is None else found.unionByName(some))
        rest = colour.where("ahead <> behind")
        ends = lambda name: rest.select(F.col("id").alias(name), F.struct("ahead", "behind").alias(f"of_{name}"))
        edges = cut(edges.hint("merge").join(ends("src"), "src").hint("merge").join(ends("dst"), "dst").where("of_src = of_dst").select("src", "dst"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges``: the smallest id of those that it reaches and that reach it, itself included.

    Repeated edges and edges from a node to itself change nothing; null ends are left out.
    """
    all_ = cut(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    left, circles, drawn = cut(all_.where("src <> dst")), [], []
    n = left.count()
    while n:
        before = n
        for turn in (False, True):
            if (out := _draw(_turned(left) if turn else left)) is not None:
                left = _turned(out[0]) if turn else out[0]
                circles.append(out[1])
                drawn.append(out[2])
        n = left.count()
        if n > before / 2:
            break
    found = _coloured(left)
    # circles belong to the step in which they were found; what was drawn earlier may lead through them
    for circle, step in zip(reversed(circles), reversed(drawn)):
        found = _undrawn(cut(found.unionByName(circle)), step)
    low = found.groupBy("component").agg(F.min("id").alias("least"))
    named = found.hint("merge").join(low, "component").select("id", F.col("least").alias("component"))
    nodes = all_.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.hint("merge").join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
