"""Bitemporal assertions: as-of reads, overlaps, versions with late arrival, periods, replay.

Both axes are half-open; a null end is open. Assertions are never updated in place: a correction is a superseding end of
the recorded interval plus appended rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.lineage import cut
from tessera.operators.ranges import dealt, running


def holds(start: str, end: str, at: int | Column) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at))


def as_of(assertions: DataFrame, valid: int, known: int, source: str | None = None) -> DataFrame:
    rows = assertions.where(holds("valid_from", "valid_to", valid) & holds("recorded_from", "recorded_to", known))
    return rows.where(F.col("source") == source) if source else rows


def as_of_join(probes: DataFrame, assertions: DataFrame, key: str, at: str) -> DataFrame:
    """Probes with the ``content`` of every version (entity_id, content, valid_from, valid_to) that held for their key at their
    time; a probe for which none held gives no row, one for which several held (versions may overlap) a row each.

    Probes and versions go by in one stream by (key, time), and the last version that began is carried along, also over ranges
    of one key: the cost is that of sorting both. Versions that a later one of their key overlaps may still hold when they are no
    longer the last; these alone meet the probes by key, and only probes of keys that have such versions.
    """
    columns = probes.columns
    begins, ends = F.col("valid_from"), F.col("valid_to")
    versions = assertions.where(begins.isNotNull() & (ends.isNull() | (ends > begins))).select(F.col("entity_id").alias("__key"), begins.alias("__time"), F.struct("valid_from", "valid_to", "content", F.expr("uuid()").alias("row")).alias("__version"))
    asked = probes.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("__key"), F.col(at).alias("__time"), F.struct(*columns).alias("__probe"))
    stream = versions.unionByName(asked, allowMissingColumns=True)
    # a version that begins at a probe's moment goes before it
    order = [F.col("__time"), F.col("__probe").isNotNull(), F.col("__version.valid_to").asc_nulls_last(), F.col("__version.row")]
    last = running(dealt(stream, "__key", order), "__key", order, "__last", F.col("__version"), "last")
    last = running(last, "__key", order, "__begun", F.col("__version"), "last", own=False)
    at_probe = last.where("__probe IS NOT NULL AND __last IS NOT NULL")
    held = (F.col("__last.valid_to").isNull() | (F.col("__last.valid_to") > F.col("__time")))
    out = at_probe.where(held).select("__probe.*", F.col("__last.content").alias("content"))
    # versions whose end lies beyond the next one's beginning
    over = last.where("__version IS NOT NULL AND __begun IS NOT NULL").select("__key", F.col("__time").alias("next"), "__begun")
    long_ = cut(over.where(F.col("__begun.valid_to").isNull() | (F.col("__begun.valid_to") > F.col("next"))).select("__key", "next", F.col("__begun").alias("__long")))
    if long_.isEmpty():
        return out
    more = at_probe.select("__key", "__time", "__probe").join(long_, "__key")
    more = more.where((F.col("__time") >= F.col("next")) & (F.col("__long.valid_to").isNull() | (F.col("__long.valid_to") > F.col("__time"))))
    return out.unionByName(more.select("__probe.*", F.col("__long.content").alias("content")))


def state_at(assertions: DataFrame, at: int, commit: str) -> DataFrame:
    """State at a commit position; positions are (time, commit id) pairs on both ends."""
    begun = (F.col("valid_from") < at) | ((F.col("valid_from") == at) & (F.col("opened_by") <= commit))
    ended = F.col("valid_to").isNotNull() & ((F.col("valid_to") < at) | ((F.col("valid_to") == at) & (F.col("closed_by") <= commit)))
    return assertions.where(begun & ~ended)


def commit_order(commits: DataFrame) -> DataFrame:
    """Each commit's position within its source and the one after it; sources are few, so ranges are placed, not sources."""
    rows = positions(commits, "source", [F.col("committed_at"), F.col("commit_id")], ["commit_id"])
    return rows.withColumnRenamed("next_commit_id", "successor")


def overlaps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of intervals of one key that share a moment; (key, a_id, b_id)."""
    x = a.select(key, F.col("id").alias("a_id"), F.col("valid_from").alias("af"), F.col("valid_to").alias("at"))
    y = b.select(key, F.col("id").alias("b_id"), F.col("valid_from").alias("bf"), F.col("valid_to").alias("bt"))
    shared = (F.col("bt").isNull() | (F.col("af") < F.col("bt"))) & (F.col("at").isNull() | (F.col("at") > F.col("bf")))
    return x.join(y, key).where(shared).select(key, "a_id", "b_id")


def discrepancies(assertions: DataFrame) -> DataFrame:
    """Shared ids with several contents: the earliest source's is primary, the others are named beside it."""
    last = assertions.groupBy("entity_id", "source").agg(F.max_by("content", F.struct("valid_from", "opened_by")).alias("content"))
    rows = last.groupBy("entity_id").agg(
        F.min_by("content", "source").alias("primary"), F.count_distinct("content").alias("n"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "source", "content"))), ",").alias("stated"),
    )
    return rows.where("n > 1").drop("n")


def binding_discrepancies(assertions: DataFrame) -> DataFrame:
    """(entity_id, variable, primary, stated): variables that sources bind to different values for one entity.

    ``assertions``: (entity_id, source, valid_from, opened_by, bindings: a map). Each source's last bindings count; a source that
    doesn't bind a variable says nothing of it. The earliest source's value is primary, all are named beside it. Last rows
    are maxima and values are joined per entity and variable, so many versions of an entity are no task of their own.
    """
    last = assertions.groupBy("entity_id", "source").agg(F.max_by("bindings", F.struct("valid_from", "opened_by")).alias("bindings"))
    bound = last.select("entity_id", "source", F.explode("bindings").alias("variable", "value")).where("value IS NOT NULL")
    rows = bound.groupBy("entity_id", "variable").agg(
        F.min_by("value", "source").alias("primary"), F.count_distinct("value").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "source", "value"))), ",").alias("stated")
    )
    return rows.where("n > 1").drop("n")


def store_version(assertions: DataFrame, version: DataFrame, source: str, at: int, recorded: int, successor: int | None) -> DataFrame:
    """The rows a new version writes and closes, tagged by action.

    Unchanged content is left alone. What changed or went is superseded (``closed``), and its earlier part stays as a
    ``truncated`` copy. For a late arrival, old content comes back (``restored``) from the successor's time on, and new
    rows (``opened``) end there. Rows of no width are never written.
    """
    now = assertions.where((F.col("source") == source) & F.col("recorded_to").isNull()).where(holds("valid_from", "valid_to", at))
    old = now.select("kind", "entity_id", F.col("content").alias("old"), F.col("valid_from").alias("vf"), F.col("valid_to").alias("vt"))
    both = old.join(version.select("kind", "entity_id", F.col("content").alias("new")), ["kind", "entity_id"], "full")
    changed = both.where(~F.col("old").eqNullSafe(F.col("new")))
    late = F.lit(successor).cast("long")
    none = F.lit(None).cast("long")

    def row(action: str, content: Column, start: Column, end: Column, known: Column, superseded: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), content.alias("content"), start.alias("valid_from"), end.alias("valid_to"), known.alias("recorded_from"), superseded.alias("recorded_to"))

    old_, new_, vf, vt, k = F.col("old"), F.col("new"), F.col("vf"), F.col("vt"), F.lit(recorded).cast("long")
    had, has = old_.isNotNull(), new_.isNotNull()
    writes = F.array(
        F.when(had, row("closed", old_, vf, vt, none, k)),
        F.when(had & (vf < at), row("truncated", old_, vf, F.lit(at).cast("long"), k, none)),
        F.when(had & late.isNotNull() & (vt.isNull() | (vt > late)), row("restored", old_, late, vt, k, none)),
        F.when(has & (late.isNull() | (late > at)), row("opened", new_, F.lit(at).cast("long"), late, k, none)),
    )
    return changed.select("kind", "entity_id", F.explode(F.array_compact(writes)).alias("w")).select("kind", "entity_id", "w.*")


def version_digests(versions: DataFrame) -> DataFrame:
    """(source, commit_id, committed_at, digest) of model versions given as rows (source, commit_id, committed_at, kind,
    entity_id, content): the same whatever the order of the rows. Sums combine on the map side."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in ("kind", "entity_id", "content")])
    part = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    rows = versions.groupBy("source", "commit_id", "committed_at").agg(F.count(F.lit(1)).alias("n"), F.sum(part).cast("string").alias("sum"))
    return rows.select("source", "commit_id", "committed_at", F.concat_ws(":", "n", "sum").alias("digest"))


def admit(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(source, commit_id, outcome, reason) of commits to store, beside those stored (source, commit_id, committed_at, digest).

    ``stored`` for a new commit, ``repeated`` for one already stored with the same time and digest (nothing is written),
    ``refused`` for one stored with another time or digest; both differences are named.
    """
    old = stored.select("source", "commit_id", F.col("committed_at").alias("old_at"), F.col("digest").alias("old_digest"))
    rows = incoming.join(old, ["source", "commit_id"], "left")
    when = F.when(F.col("old_at") != F.col("committed_at"), "a different commit time")
    what = F.when(F.col("old_digest") != F.col("digest"), F.concat(F.lit("stored digest "), "old_digest", F.lit(" differs from incoming digest "), "digest"))
    reason = F.concat_ws("; ", when, what)
    outcome = F.when(F.col("old_digest").isNull(), "stored").when(reason == "", "repeated").otherwise("refused")
    return rows.select("source", "commit_id", outcome.alias("outcome"), F.when(outcome == "refused", reason).alias("reason"))


def recorded_times(arrivals: DataFrame, source: str, seq: str, clock: str) -> DataFrame:
    """``arrivals`` with ``recorded``: the clock's time, or 1 ms past the source's previous recorded time where the clock
    hasn't moved beyond it. Recorded time only ever increases within a source: a running maximum of (time - position), plus the
    position. Sources are few: place and maximum are carried over ranges of their arrivals."""
    order = [F.col(seq)]
    placed = running(dealt(arrivals, source, order), source, order, "__n", F.lit(1).cast("long"), "sum")
    ahead = running(placed, source, order, "__ahead", F.col(clock) - F.col("__n"))
    return ahead.withColumn("recorded", F.col("__ahead") + F.col("__n")).select(*arrivals.columns, "recorded")


def positions(rows: DataFrame, group: str, order: list[Column], names: list[str], name: str = "position") -> DataFrame:
    """``rows`` with their place (from 1) within ``group`` by ``order``, and of each column in ``names`` the next row's value.

    A few groups of many rows would be sorted in as many tasks. Instead rows are dealt by ranges of (group, order), placed
    within their range, and moved by the rows of the same group in earlier ranges; those counts, one row a range and group,
    are as few as there are ranges.
    """
    spark = rows.sparkSession
    dealt = cut(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col(group), *order).withColumn("__range", F.spark_partition_id()))
    inner = W.partitionBy("__range", group).orderBy(*order)
    placed = dealt.withColumn("__rank", F.row_number().over(inner)).withColumns({f"__next_{c}": F.lead(c).over(inner) for c in names})
    first = F.min_by(F.struct(*names) if names else F.lit(1), "__rank")
    ranges = placed.groupBy("__range", group).agg(F.count(F.lit(1)).alias("__many"), first.alias("__first"))
    outer = W.partitionBy(group).orderBy("__range")
    before = F.coalesce(F.sum("__many").over(outer.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    moved = ranges.select(F.col("__range").alias("__r"), F.col(group).alias("__g"), before.alias("__before"), F.lead("__first").over(outer).alias("__after"))
    # one row a range and group
    joined = placed.join(F.broadcast(moved), (F.col("__range") == F.col("__r")) & F.col(group).eqNullSafe(F.col("__g")))
    last = {f"next_{c}": F.coalesce(F.col(f"__next_{c}"), F.col("__after")[c]) for c in names}
    out = joined.withColumns({name: (F.col("__before") + F.col("__rank")).cast("int"), **last})
    return out.select(*rows.columns, name, *last)


def periods(changes: DataFrame, key: str, order: list[str], flag: str, opens: str, closes: str) -> DataFrame:
    """(key, opened, closed): an opening while open and a closing while closed change nothing."""
    by = W.partitionBy(key).orderBy(*order)
    rows = changes.where(F.col(flag).isin(opens, closes)).withColumn("before", F.lag(flag).over(by))
    turn = rows.where(((F.col(flag) == opens) & (F.col("before").isNull() | (F.col("before") == closes))) | ((F.col(flag) == closes) & (F.col("before") == opens)))
    return turn.withColumn("closed", F.lead("tick").over(by)).where(F.col(flag) == opens).select(key, F.col("tick").alias("opened"), "closed")


def replay(journal: DataFrame, key: str, seq: str, opens: tuple[str, ...], closes: tuple[str, ...], evidence: tuple[str, ...]) -> DataFrame:
    """Folds a journal: ids whose last opening or closing event opens, with their last evidence."""
    kind = F.col("event_type")
    turning = F.when(kind.isin(*opens, *closes), F.col(seq))
    rows = journal.groupBy(key).agg(
        F.max_by(F.when(kind.isin(*opens), True).when(kind.isin(*closes), False), turning).alias("is_open"),
        F.max(turning).alias("since"), F.max(F.when(kind.isin(*evidence), F.col(seq))).alias("evidence"), F.count(F.lit(1)).alias("events"),
    )
    return rows.where("is_open").drop("is_open")


def replay_graph(operations: DataFrame) -> DataFrame:
    """(what, id, since, operations) of what stands after a journal: vertices, edges and opinions.

    ``operations``: (seq, what, id, opens, ends): ``what`` is vertex, edge or opinion, ``opens`` whether it is stated or withdrawn,
    ``ends`` the vertices it hangs on (none, two, the holder). What was stated last stands, and hangs on nothing that has gone:
    with a vertex go its edges and opinions, and when it comes back, so do they. ``since`` is the last operation on it. Folds are
    maxima by seq, so an id of very many operations is combined before the shuffle.
    """
    rows = operations.groupBy("what", "id").agg(F.max_by(F.struct("opens", "ends"), "seq").alias("last"), F.max("seq").alias("since"), F.count(F.lit(1)).alias("operations")).where("last.opens")
    standing = cut(rows.select("what", "id", "last.ends", "since", "operations"))
    vertices = standing.where("what = 'vertex'").select(F.col("id").alias("end"))
    gone = standing.where("what <> 'vertex'").select("what", "id", F.explode("ends").alias("end")).join(vertices, "end", "left_anti").select("what", "id").distinct()
    return standing.join(gone, ["what", "id"], "left_anti").drop("ends")


def shortest_prefixes(uids: DataFrame, uid: str, head: int = 4) -> DataFrame:
    """Shortest unambiguous hex prefix of every uid.

    The longest prefix shared with any other uid is shared with a sort neighbour. Neighbours within a head of ``head``
    digits are found per head; across heads, among the at most 16^head heads.
    """

    def common(a: Column, b: Column, most: int) -> Column:
        same = F.array(*[F.when(F.substring(a, 1, i) == F.substring(b, 1, i), F.lit(i)).otherwise(F.lit(0)) for i in range(1, most + 1)])
        return F.when(b.isNull(), F.lit(0)).otherwise(F.array_max(same))

    h = F.substring(uid, 1, head)
    rows = uids.withColumn("h", h)
    heads = rows.select("h").distinct()  # bounded by 16^head
    by = W.orderBy("h")
    heads = heads.select("h", F.greatest(common(F.col("h"), F.lag("h").over(by), head), common(F.col("h"), F.lead("h").over(by), head)).alias("outside"))
    inner = W.partitionBy("h").orderBy(uid)
    inside = F.greatest(common(F.col(uid), F.lag(uid).over(inner), 40), common(F.col(uid), F.lead(uid).over(inner), 40))
    return rows.withColumn("inside", inside).join(heads, "h").withColumn("prefix", F.expr(f"substring({uid}, 1, greatest(inside, outside) + 1)")).drop("h", "inside", "outside")


def children_as_of(assertions: DataFrame, parents: DataFrame, valid: int, known: int, parent: object = None) -> DataFrame:
    """(parent, child) of the elements that existed at a time, as known at another; ``parents``: (entity_id, parent).

    With ``parent``, the children of that element alone; asking for one that didn't exist then is an error. Parents that didn't
    exist have no rows.
    """
    held = as_of(assertions, valid, known).select("entity_id").distinct()
    if parent is not None:
        if held.where(F.col("entity_id") == parent).isEmpty():
            raise ValueError(f"{parent} does not exist at {valid}")
        parents = parents.where(F.col("parent") == parent)
    pairs = parents.select("parent", "entity_id").join(held, "entity_id", "left_semi")
    return pairs.join(held.select(F.col("entity_id").alias("parent")), "parent", "left_semi").select("parent", F.col("entity_id").alias("child"))
