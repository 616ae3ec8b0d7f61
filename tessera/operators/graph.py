"""Graph operators over edge lists (src, dst): bounded traversal, co-occurrence, neighbourhoods, closures, lifted views.

Depths are small and fixed, so traversals are unrolled joins with a distinct per level; only true closures iterate, and
cut their lineage by reliable checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.lineage import cut, spread, stored
from tessera.operators.connections import combined_top, grouped_top
from tessera.operators.cycles import components
from tessera.operators.temporal import holds


def related(origins: DataFrame, edges: DataFrame, depth: int, live: DataFrame | None = None, inverse: bool = False) -> DataFrame:
    """(origin, node, hops): nodes within ``depth`` steps src -> dst (``inverse``: dst -> src), at their least distance.

    The origin itself is excluded; nodes that ``live`` (id) doesn't list are neither reached nor passed. A node found before
    isn't expanded again.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth must be between 1 and 3")
    step = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if inverse else edges.select("src", "dst")
    if live is not None:
        step = step.join(live.select(F.col("id").alias("dst")), "dst", "left_semi")
    front = origins.select(F.col("id").alias("origin"), F.col("id").alias("node"))
    found = None
    for hop in range(1, depth + 1):
        front = front.join(step, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).where("node <> origin").distinct()
        if found is not None:
            front = front.join(found.select("origin", "node"), ["origin", "node"], "left_anti")
        level = front.withColumn("hops", F.lit(hop))
        found = level if found is None else found.unionByName(level)
    return found


def related_page(
    origins: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int, order: Sequence[Column], first: int, inverse: bool = False,
    kinds: Sequence[str] = (), condition: Column | None = None, tasks: int = 0,
) -> DataFrame:
    """Each origin's first related nodes of the kinds asked, under a condition on their fields and in their order, with the
    total before paging. Nodes that the kinds or the condition leave out are still passed on the way.

    Edges meet live nodes once, for all steps, over ``tasks`` tasks if these are more than a shuffle has."""
    if condition is not None and len(kinds) != 1:
        raise ValueError("a condition needs one declared kind")
    live = nodes.where(~F.col("removed"))
    wanted = live.where(F.col("kind").isin(*kinds)) if kinds else live
    wanted = wanted.where(condition) if condition is not None else wanted
    end = "src" if inverse else "dst"
    ids = spread(live.select(F.col("id").alias(end)), tasks, end)
    alive = stored(spread(edges.select("src", "dst"), tasks, end).join(ids, end, "left_semi"))
    rows = stored(related(origins, alive, depth, inverse=inverse).join(wanted.withColumnRenamed("id", "node"), "node"))
    return grouped_top(rows, ["origin"], [*order, F.asc("node")], first + 1)


#: Ids of more neighbours than this aren't taken apart into pairs of neighbours.
FEW = 64

#: Rows of co-change for one task.
MEETING = 250_000


def cochange(edges: DataFrame, first: int, least: int = 2, both: bool = False, block: int = 1_000, tasks: int = 0) -> DataFrame:
    """For every dst: the dsts it shares most srcs with. n shared srcs (>= least), share of its own in percent.

    ``both`` reads the edges in either direction. Ids with few neighbours in crowded places meet under pairs of neighbours, of
    which ids that share n have n (n - 1) / 2 in common: under these, only ids that share two or more meet. Pairs with another id
    meet under each neighbour. Crowds are dealt over blocks of about ``block``; each pair of blocks is one join key, so no task
    gets more than two blocks of one. A pair is counted once and mirrored after. ``tasks``: over how many tasks edges become
    distinct, if these are more than a shuffle has; the others follow from the rows there are.
    """
    way = lambda near, id_: F.struct(F.col(near).alias("near"), F.col(id_).alias("id"))
    ways = [way("src", "dst"), way("dst", "src")] if both else [way("src", "dst")]
    pairs = stored(spread(edges.select(F.inline(F.array(*ways))), tasks, "near").distinct())
    pairs = spread(pairs, -(-pairs.count() // MEETING), "near")
    pairs = pairs.join(pairs.groupBy("near").agg(F.count(F.lit(1)).alias("crowd")), "near")
    sizes = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("total"), F.sum("crowd").alias("others"))
    few = (F.col("total") <= FEW) & (F.col("total") * (F.col("total") - 1) / 2 <= F.col("others") - F.col("total"))
    sizes = stored(sizes.select("id", "total", (few if least >= 2 else F.lit(False)).alias("few")))
    rows = stored(pairs.where("crowd > 1").join(sizes, "id").select("near", "id", "crowd", "few"))
    tasks = -(-rows.count() // MEETING)
    n = _met(rows, ["near"], block, tasks).groupBy("id", "with").agg(F.count(F.lit(1)).alias("n"))
    if least >= 2:
        of = rows.where("few").groupBy("id").agg(F.array_sort(F.collect_list("near")).alias("of")).where(F.size("of") > 1)
        two = "flatten(transform(of, (x, i) -> transform(slice(of, i + 2, size(of)), y -> struct(x AS one, y AS two))))"
        keys = stored(of.select("id", F.inline(F.expr(two))))
        keys = spread(keys, -(-keys.count() // MEETING), "one", "two")
        crowd = keys.groupBy("one", "two").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
        shared = _met(keys.join(crowd, ["one", "two"]).withColumn("few", F.lit(False)), ["one", "two"], block).groupBy("id", "with").agg(F.count(F.lit(1)).alias("n"))
        n = n.unionByName(shared.select("id", "with", F.round((1 + F.sqrt(1 + 8 * F.col("n"))) / 2).cast("long").alias("n")))
    n = n.where(F.col("n") >= least)
    sides = F.array(F.struct(F.col("id").alias("id"), F.col("with").alias("other")), F.struct(F.col("with").alias("id"), F.col("id").alias("other")))
    mirrored = n.select("n", F.inline(sides))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("n"), "other"))
    top = mirrored.withColumn("rn", rank).where(F.col("rn") <= first)
    return top.join(sizes.select("id", "total"), "id").select("id", "other", "n", "total", F.round(F.col("n") / F.col("total") * 100, 6).alias("share"), "rn")


def _met(rows: DataFrame, key: list[str], block: int, tasks: int = 0) -> DataFrame:
    """(id, with), id < with, once for every key under which two ids meet, of which not both are ``few``. ``crowd``: rows of the
    key. Keys meet over ``tasks`` tasks, and so do the pairs, if these are more than a shuffle has."""
    dealt = rows.withColumn("blocks", F.ceil(F.col("crowd") / block).cast("int")).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = dealt.select(*key, F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "id", "mine", "few")
    right = keyed.select(*key, "low", "high", F.col("id").alias("with"), F.col("mine").alias("theirs"), F.col("few").alias("few_"))
    met = spread(keyed.where("NOT few"), tasks, *key, "low", "high").join(right, [*key, "low", "high"]).where((F.least("mine", "theirs") == F.col("low")) & (F.greatest("mine", "theirs") == F.col("high")))
    # ids of few neighbours stand only on the right
    met = met.where("id < with OR few_ AND id <> with").select(F.least("id", "with").alias("id"), F.greatest("id", "with").alias("with"))
    return spread(met, tasks, "id", "with")


def contributors(through: DataFrame, edge: DataFrame, first: int) -> DataFrame:
    """Two hops against the edges' direction, paths counted as a bag: for each dst of ``edge`` the srcs of ``through``."""
    paths = edge.select("dst", F.col("src").alias("mid")).join(through.select(F.col("src").alias("far"), F.col("dst").alias("mid")), "mid")
    n = paths.groupBy("dst", "far").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rn", F.row_number().over(W.partitionBy("dst").orderBy(F.desc("n"), "far"))).where(F.col("rn") <= first)


def both_sides(edges: DataFrame, nodes: DataFrame, tasks: int = 0) -> DataFrame:
    """(id, side, rel, other, kind): out and in edges of every node; a self-loop only as out. Edges are read once, and meet the
    nodes over ``tasks`` tasks if these are more than a shuffle has."""
    side = lambda name, id_, other: F.struct(F.col(id_).alias("id"), F.lit(name).alias("side"), F.col("rel"), F.col(other).alias("other"))
    sides = edges.select(F.inline(F.array(side("out", "src", "dst"), side("in", "dst", "src")))).where("side = 'out' OR id <> other")
    return spread(sides, tasks, "other").join(nodes.select(F.col("id").alias("other"), "kind"), "other")


def fold(groups: DataFrame, keys: Sequence[str], other: str, bound: int, tasks: int = 0) -> DataFrame:
    """Groups of more than ``bound`` become one row with their count; the others keep their members."""
    top = combined_top(groups, keys, other, bound, tasks)
    rows = top.withColumn("member", F.when(F.col("total") <= bound, F.col(other)))
    return rows.groupBy(*keys, "member").agg(F.when(F.first("total") > bound, F.first("total")).alias("folded"))


def trail(start: DataFrame, parents: DataFrame, steps: int = 8) -> DataFrame:
    """(id, trail): the containers of each node, outermost first, joined by '/'; stops on a revisit."""
    rows = start.select("id", F.col("id").alias("at"), F.array(F.col("id")).alias("path"))
    up = parents.select(F.col("src").alias("at"), F.col("dst").alias("up"))
    for _ in range(steps):
        rows = rows.join(up, "at", "left")
        new = F.col("up").isNotNull() & ~F.array_contains("path", F.col("up"))
        rows = rows.select("id", F.when(new, F.col("up")).alias("at"), F.when(new, F.array_append("path", F.col("up"))).otherwise(F.col("path")).alias("path"))
    return rows.select("id", F.array_join(F.reverse(F.slice("path", 2, 1_000)), "/").alias("trail"))


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of all paths of one edge or more, cycles included. Path lengths double each round."""
    known = cut(edges.select("src", "dst").distinct())
    n = known.count()
    while True:
        longer = known.select("src", F.col("dst").alias("mid")).join(known.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        known = cut(known.unionByName(longer).distinct())
        m = known.count()
        if m == n:
            return known
        n = m


def chains(edges: DataFrame) -> DataFrame:
    """(id, root, steps): where the chain of each node of ``edges`` (src -> its one dst) ends, and how far that is.

    Pointer doubling: one row a node, as many rounds as the longest chain has binary digits. Nodes that lead into a cycle
    have no root and give no row.
    """
    now = cut(edges.select(F.col("src").alias("id"), F.col("dst").alias("root"), F.lit(1).cast("long").alias("steps")))
    open_, most = now.count(), 0
    while open_ and most < 63:
        far = now.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("steps").alias("more"))
        now = cut(now.join(far, "root", "left").select("id", F.coalesce("next", "root").alias("root"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")))
        moved = now.where("moved").count()
        now, most = now.drop("moved"), most + 1
        # what still moves after more rounds than there are digits runs in circles
        if not moved or 2**most > 2 * open_:
            break
    return now.join(edges.select(F.col("src").alias("root")), "root", "left_anti").select("id", "root", "steps")


def chain_faults(states: DataFrame, subject: str, rows: int = 500_000) -> DataFrame:
    """(subject, roots, followers, states, unreached) of chains (subject, id, prev): states without a predecessor, the most
    followers that one has, and those that no root leads to. A sound chain has one root, one follower each and all reached.

    States are dealt by ranges of (subject, id), of about ``rows``; a task follows the chains within its range, and only
    the states at which a chain enters another range are followed further, by pointer doubling.
    """
    spark, kind = states.sparkSession, states.schema["id"].dataType.simpleString()
    states = stored(states.select(subject, "id", F.col("prev").cast(kind).alias("prev")))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-states.count() // rows))
    held = f"{subject} {states.schema[subject].dataType.simpleString()}, root boolean, led boolean, at {kind}, id {kind}"
    near = stored(states.repartitionByRange(n, subject, "id").mapInArrow(_followed, held))
    asked = near.where("at IS NOT NULL").select(F.col("at").alias("id")).distinct()
    entered = cut(near.join(asked, "id", "left_semi").select("id", "led", "at"))
    roots = entered.where("led").select(F.col("id").alias("root"))
    led = chains(entered.where("at IS NOT NULL").select(F.col("id").alias("src"), F.col("at").alias("dst"))).join(roots, "root", "left_semi").select(F.col("id").alias("at"))
    led = led.unionByName(roots.select(F.col("root").alias("at"))).distinct().withColumn("further", F.lit(True))
    # as few rows as ways out of a range, for each subject
    some = near.groupBy(subject, "at").agg(F.count_if("root").alias("roots"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("led")).alias("open")).join(led, "at", "left")
    totals = some.groupBy(subject).agg(F.sum("roots").alias("roots"), F.sum("n").alias("states"), F.coalesce(F.sum(F.when(F.col("further").isNull(), F.col("open"))), F.lit(0).cast("long")).alias("unreached"))
    followers = states.where("prev IS NOT NULL").groupBy(F.col("prev").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    most = states.select(subject, "id").join(followers, "id").groupBy(F.col(subject).alias("__of")).agg(F.max("n").alias("followers"))
    return totals.join(most, F.col(subject).eqNullSafe(F.col("__of")), "left").select(subject, "roots", F.coalesce("followers", F.lit(0).cast("long")).alias("followers"), "states", "unreached")


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(subject, root, led, at, id) of the states of one range: whether a root in it leads to the state, else the state outside
    at which its chain goes on; neither for circles."""
    all_ = list(batches)
    if not all_:
        return
    whole = pa.Table.from_batches(all_).combine_chunks()
    of, ids, prev = whole.columns
    inside = pc.index_in(prev, value_set=ids, skip_nulls=True)
    end = np.asarray(pc.is_null(inside))
    jump = np.where(end, np.arange(len(end)), np.asarray(pc.fill_null(inside, 0)))
    for _ in range(len(end).bit_length()):
        jump = jump[jump]
    root = np.asarray(pc.is_null(prev))
    at = pc.if_else(pa.array(end[jump]), prev.take(pa.array(jump)), pa.scalar(None, prev.type))
    out = pa.table([of, pa.array(root), pa.array(end[jump] & root[jump]), at, ids], names=[whole.column_names[0], "root", "led", "at", "id"])
    yield from out.to_batches(max_chunksize=10_000)


def starved(consumes: DataFrame, produces: DataFrame) -> DataFrame:
    """(stage, steps, path): stages that wait for a capability which no stage provides, with the shortest way to it.

    ``consumes`` and ``produces``: (stage, capability). A capability whose producers all starve is missing as well; of several
    ways the smallest by name. ``path`` names capabilities from the stage's own to the missing one. As many rounds as the
    longest of these ways: a round ends the search only when it finds no further stage. No round sends a table through the
    driver, as joins by broadcast would.
    """
    missing = cut(consumes.select("capability").distinct().hint("merge").join(produces, "capability", "left_anti").select("capability", F.col("capability").cast("string").alias("path")))
    found, gone, step = None, missing.select("capability"), 0
    while not missing.isEmpty():
        step += 1
        waits = consumes.hint("merge").join(missing, "capability").groupBy("stage").agg(F.min("path").alias("path")).withColumn("steps", F.lit(step))
        waits = cut(waits.hint("merge").join(found.select("stage"), "stage", "left_anti") if found is not None else waits)
        found = cut(waits if found is None else found.unionByName(waits))
        # capabilities all of whose producers starve by now
        fed = produces.hint("merge").join(found.select("stage"), "stage", "left_anti").select("capability").distinct()
        lost = produces.hint("merge").join(waits, "stage").hint("merge").join(fed, "capability", "left_anti").hint("merge").join(gone, "capability", "left_anti")
        missing = cut(lost.groupBy("capability").agg(F.min(F.concat_ws(">", F.col("capability").cast("string"), "path")).alias("path")))
        gone = cut(gone.unionByName(missing.select("capability")))
    return found if found is not None else consumes.select("stage", F.lit(0).alias("steps"), F.lit("").alias("path")).where("false")


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, level): 0 without dependencies (src depends on dst), else one more than the deepest; cycles are left out."""
    left = cut(edges.select("src", "dst").distinct())
    todo, done, level = nodes.select("id").distinct(), None, 0
    while True:
        ready = cut(todo.join(left.select(F.col("src").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            return done if done is not None else ready
        done = ready if done is None else done.unionByName(ready)
        todo = cut(todo.join(ready, "id", "left_anti"))
        left = cut(left.join(ready.select(F.col("id").alias("dst")), "dst", "left_anti"))
        level += 1


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves: those of components of several nodes, and those with an edge to themselves."""
    named = cut(components(edges))
    many = named.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return named.join(many, "component", "left_semi").select("id").unionByName(edges.where("src = dst").select(F.col("src").alias("id"))).distinct()


def first_cycle(edges: DataFrame) -> DataFrame:
    """(place, id): the shortest cycle through the smallest node that is on one, as a path from it back to it.

    Of several, the one that takes the smaller node where they part. The search goes along the edges of that node's component,
    one distance at a time, and keeps the smallest path to each node; it ends when it is back, as it must within as many rounds
    as the component has nodes.
    """
    nodes = cut(on_cycles(edges))
    start = nodes.agg(F.min("id")).first()[0]
    if start is None:
        return nodes.select(F.lit(0).alias("place"), "id").where("false")
    inner = cut(edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct())
    front = inner.where(F.col("src") == start).groupBy("dst").agg(F.min(F.array("src", "dst")).alias("path"))
    seen = front.select("dst")
    while True:
        closed = front.where(F.col("dst") == start).select(F.posexplode("path").alias("place", "id"))
        if not closed.isEmpty():
            return closed
        front = front.select(F.col("dst").alias("src"), "path").join(inner, "src").groupBy("dst").agg(F.min(F.array_append("path", F.col("dst"))).alias("path"))
        front = cut(front.join(seen, "dst", "left_anti"))
        seen = cut(seen.unionByName(front.select("dst")))


def ancestors(parents: DataFrame, shown: DataFrame, depth: int) -> DataFrame:
    """(id, shown): each element's nearest shown ancestor or itself, at most ``depth`` levels up."""
    up = parents.select(F.col("src").alias("at"), F.col("dst").alias("up"))
    rows = parents.select(F.col("src").alias("id")).unionByName(shown.select("id")).distinct()
    rows = rows.join(shown.select("id", F.col("id").alias("shown")), "id", "left").withColumn("at", F.col("id"))
    for _ in range(depth):
        rows = rows.join(up, "at", "left").withColumn("at", F.when(F.col("shown").isNull(), F.col("up"))).drop("up")
        rows = rows.join(shown.select(F.col("id").alias("at"), F.col("id").alias("s")), "at", "left").withColumn("shown", F.coalesce("shown", "s")).drop("s")
    return rows.where("shown IS NOT NULL").select("id", "shown")


def lifted(relations: DataFrame, ancestor: DataFrame, ids: Column) -> DataFrame:
    """Relations between shown elements: both ends lifted, pairs merged, self pairs dropped."""
    a = ancestor.select(F.col("id").alias("src"), F.col("shown").alias("from_id"))
    b = ancestor.select(F.col("id").alias("dst"), F.col("shown").alias("to_id"))
    pairs = relations.join(a, "src").join(b, "dst").where("from_id <> to_id")
    return pairs.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n"), F.min(ids).alias("first_relation"), F.max(ids).alias("last_relation"))


def view(elements: DataFrame, relations: DataFrame, scope: object, depth: int, context: bool = False, levels: int = 8) -> DataFrame:
    """(from_id, to_id, n, first_relation, last_relation): the relations (id, src, dst) that a view of ``scope`` draws.

    Shown are the elements (id, parent) inside the scope, down to ``depth`` levels; ends lie on their nearest shown ancestor.
    With ``context``, relations across the boundary are drawn too: their outer end lies on its ancestor (or itself) whose parent
    is the scope's parent or one of its ancestors, or which has no parent. Pairs are merged, relations within one box dropped.
    A tree deeper than ``levels`` fails the query rather than lift an end to the wrong box.
    """
    up = elements.select(F.col("id").alias("at"), F.col("parent").alias("up"))
    # each element with its ancestors, itself first
    rows = elements.select("id", F.col("id").alias("at"), F.array("id").alias("line"))
    for _ in range(levels):
        rows = rows.join(up, "at", "left").select("id", F.col("up").alias("at"), F.when(F.col("up").isNotNull(), F.array_append("line", F.col("up"))).otherwise(F.col("line")).alias("line"))
    deeper = rows.join(up, "at", "left").withColumn("line", F.when(F.col("up").isNull(), F.col("line")).otherwise(F.raise_error(F.lit(f"an element lies deeper than {levels} levels"))))
    rows = deeper.select("id", "line")
    line = F.col("line")
    own = rows.where(F.col("id") == scope).select(F.slice(line, 2, levels + 1).alias("above"))  # one row
    place = F.array_position(line, F.lit(scope)).cast("int")  # 0 outside, 1 the scope itself
    inside = F.when(place > 1, F.element_at(line, F.greatest(place - depth, F.lit(1))))
    # the first of the line whose parent is above the scope, or the last, which has none
    shared = F.filter(F.sequence(F.lit(1), F.size(line)), lambda i: (i == F.size(line)) | F.array_contains("above", F.try_element_at(line, i + 1)))
    outside = F.when(place == 0, F.element_at(line, F.element_at(shared, 1)))
    lifted_ = rows.crossJoin(F.broadcast(own)).select("id", inside.alias("inner"), (outside if context else F.lit(None)).alias("outer"))
    a = lifted_.select(F.col("id").alias("src"), F.col("inner").alias("a_in"), F.col("outer").alias("a_out"))
    b = lifted_.select(F.col("id").alias("dst"), F.col("inner").alias("b_in"), F.col("outer").alias("b_out"))
    ends = relations.join(a, "src").join(b, "dst").where("a_in IS NOT NULL OR b_in IS NOT NULL")
    pairs = ends.select("id", F.coalesce("a_in", "a_out").alias("from_id"), F.coalesce("b_in", "b_out").alias("to_id")).where("from_id <> to_id")
    return pairs.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_relation"), F.max("id").alias("last_relation"))


def without_refinements(relations: DataFrame, drawn: DataFrame) -> DataFrame:
    """Relations (id, src, dst, refines) without the refinements of a relation that the view draws (``drawn``: id)."""
    return relations.join(drawn.select(F.col("id").alias("refines")).distinct(), "refines", "left_anti")


def dependents(origins: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(origin, node, hops, chain): nodes that lead to the origin, with the shortest relation chain, ties by code point.

    A node found before isn't expanded again: what it leads to has a shorter chain already.
    """
    rows = origins.select(F.col("id").alias("origin"), F.col("id").alias("node"), F.lit("").alias("chain"))
    found = None
    for h in range(1, hops + 1):
        nxt = rows.join(edges.select(F.col("dst").alias("node"), "src", "rel"), "node").where("src <> origin")
        chain = F.when(F.col("chain") == "", F.col("rel")).otherwise(F.concat_ws(">", "chain", "rel"))
        rows = nxt.select("origin", F.col("src").alias("node"), chain.alias("chain")).groupBy("origin", "node").agg(F.min("chain").alias("chain"))
        if found is not None:
            rows = rows.join(found.select("origin", "node"), ["origin", "node"], "left_anti")
        level = rows.withColumn("hops", F.lit(h))
        found = level if found is None else found.unionByName(level)
    return found.select("origin", "node", "hops", "chain")


def dependents_as_of(origins: DataFrame, relations: DataFrame, hops: int, at: int) -> DataFrame:
    """Dependents along the relations (rel, src, dst, valid_from, valid_to) that hold at ``at``, on every hop."""
    return dependents(origins, relations.where(holds("valid_from", "valid_to", at)).select("rel", "src", "dst"), hops)
