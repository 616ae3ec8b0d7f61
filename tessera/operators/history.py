"""Version-control history: first-parent chains, periods of existence and dates of files, in ancestry order.

Commits (repository, commit_id, committed_at, position, walk): ``position`` is the commit's place in the ancestry order of its
repository, parents first, and ``walk`` its place in the log, newest first; both are what the version control itself lists.
Commit dates order nothing: a backdated commit comes after its parents all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.lineage import cut, spread

OPENS, CLOSES = ("added", "renamed"), ("deleted",)


def first_parents(pins: DataFrame, parents: DataFrame) -> DataFrame:
    """(repository, commit_id, steps): each pin (repository, commit_id) and the commits that its first parents lead to.

    ``parents``: (commit_id, place, parent); place 0 is the first. Pointer doubling: jumps of 1, 2, 4 ... first parents, and after
    each round those commits that are twice as many steps away. As many rounds as the longest chain has binary digits, each a
    join of at most one row a commit.
    """
    jump = cut(parents.where("place = 0").select(F.col("commit_id").alias("at"), "parent"))
    found = cut(pins.select("repository", F.col("commit_id").alias("at"), F.lit(0).cast("long").alias("steps")))
    n, reach = found.count(), 1
    while True:
        further = found.join(jump, "at").select("repository", F.col("parent").alias("at"), (F.col("steps") + reach).alias("steps"))
        found = cut(found.unionByName(further))
        m = found.count()
        if m == n:
            return found.select("repository", F.col("at").alias("commit_id"), "steps")
        n, reach = m, reach * 2
        jump = cut(jump.join(jump.select(F.col("at").alias("parent"), F.col("parent").alias("far")), "parent").select("at", F.col("far").alias("parent")))


def _began_and_ended(changes: DataFrame, *more: Column) -> Column:
    """Sides (path, opened, ended, ``more``) of a change, as an array: that of its path and that of the path it renames, which has
    none of ``more``. Ends are (position, place, committed_at, commit_id).

    What is added or renamed to begins a period and clears its end; what is deleted or renamed from ends it, also one that has
    no beginning. At a ``boundary``, a commit whose parents are cut off, everything looks added, so nothing begins there.
    Changes of one commit are taken by ``place``.
    """
    what = F.struct("position", "place", "committed_at", "commit_id")
    kind = "struct<" + ",".join(f"{c}:{changes.schema[c].dataType.simpleString()}" for c in ("position", "place", "committed_at", "commit_id")) + ">"
    opens = F.when(F.col("change").isin(*OPENS) & ~F.col("boundary"), what)
    names = changes.select(*more).schema
    own = F.struct("path", opens.alias("opened"), F.when(F.col("change").isin(*CLOSES), what).alias("ended"), *more)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in names]
    before = F.struct(F.col("previous").alias("path"), F.lit(None).cast(kind).alias("opened"), what.alias("ended"), *none)
    return F.array_compact(F.array(own, F.when((F.col("change") == "renamed") & F.col("previous").isNotNull(), before)))


def _period(opened: str, ended: str) -> Column:
    """The latest period between two such ends, null without both."""
    o, e = (lambda c: F.col(f"{opened}.{c}")), (lambda c: F.col(f"{ended}.{c}"))
    later = F.col(opened).isNull() | (F.struct(e("position"), e("place")) >= F.struct(o("position"), o("place")))
    end = lambda c: F.when(later, e(c))
    period = F.struct(o("committed_at").alias("added_at"), o("commit_id").alias("added_in"), end("committed_at").alias("removed_at"), end("commit_id").alias("removed_in"))
    return F.when(F.col(opened).isNotNull() | F.col(ended).isNotNull(), period)


def path_periods(changes: DataFrame, commits: DataFrame, parents: DataFrame, pins: DataFrame, tree: DataFrame | None = None, tasks: int = 0) -> DataFrame:
    """(repository, path, commit_count, last_change, added_at, added_in, removed_at, removed_in) of every path that the history or
    the tree names.

    ``changes``: (repository, commit_id, path, change, previous, place), without repository where a commit id has only one;
    ``tree``: (repository, path) at the pin; without it, changes tell in ``here`` whether the tree has their path. A period
    follows the commits of the pin's first-parent chain, merges included: what a merge discards is no change. A path that the
    tree lacks and the chain leaves without an end takes its period from all commits; if those state no end either, it ends at
    the pin. Counts and the last date are those of all commits that changed the path itself.

    Changes meet their commits, and then once the others of their path, for all these facts together: over ``tasks`` tasks,
    if these are more than a shuffle has. The changes of one path in one repository then meet in one task, which keeps maxima only.
    """
    key, commit = ["repository", "path"], ["repository", "commit_id"]
    dated = commits.select(*commit, "committed_at", "position", "boundary" if "boundary" in commits.columns else F.lit(False).alias("boundary"))
    chain = first_parents(pins, parents).select(*commit).distinct().withColumn("straight", F.lit(True))
    marked = dated.join(chain, commit, "left")
    on = [c for c in commit if c in changes.columns]
    met = spread(changes, tasks, *on).join(marked, on)
    # a commit's path counts at its first row, where its rows lie together anyway
    new = F.row_number().over(W.partitionBy(*commit, "path").orderBy("place")) == 1
    own = [F.col("new"), F.col("committed_at").alias("changed_at"), F.lit(None).cast("boolean").alias("here") if tree is not None else F.col("here")]
    met = met.withColumn("new", new)
    sides = met.select("repository", "straight", F.inline(_began_and_ended(met, *own)))
    if tree is not None:
        sides = sides.unionByName(tree.select(*key, F.lit(True).alias("here")), allowMissingColumns=True)
    on_chain = lambda c: F.max(F.when(F.col("straight"), F.col(c)))
    rows = spread(sides, tasks, *key).groupBy(*key).agg(
        F.count_if("new").alias("commit_count"), F.max("changed_at").alias("last_change"), F.max("here").alias("here"),
        F.max("opened").alias("o"), F.max("ended").alias("e"), on_chain("opened").alias("so"), on_chain("ended").alias("se"),
    )
    pinned = pins.join(dated, commit).select("repository", F.col("commit_id").alias("pin"), F.col("committed_at").alias("pinned_at"))
    rows = rows.join(F.broadcast(pinned) if pins.count() <= 100_000 else pinned, "repository", "left")
    gone = ~F.coalesce("here", F.lit(False))
    rows = rows.withColumn("straight", _period("so", "se"))
    open_ = F.col("straight").isNull() | F.col("straight.removed_at").isNull()
    rows = rows.withColumn("held", F.when(gone & open_, _period("o", "e")).otherwise(F.col("straight")))
    # a path without any beginning or end has no period to close
    lost = gone & F.col("held").isNotNull() & F.col("held.removed_at").isNull()
    return rows.select(
        *key, "commit_count", "last_change", "held.added_at", "held.added_in",
        F.when(lost, F.col("pinned_at")).otherwise(F.col("held.removed_at")).alias("removed_at"), F.when(lost, F.col("pin")).otherwise(F.col("held.removed_in")).alias("removed_in"),
    )


def _named(prefix: str, place: Column) -> list[Column]:
    return [F.col(f"{place}.commit_id").alias(f"{prefix}_in"), F.col(f"{place}.committed_at").alias(f"{prefix}_at"), F.col(f"{place}.author").alias(f"{prefix}_by")]


def file_dates(changes: DataFrame, rooted: DataFrame, tasks: int = 0) -> DataFrame:
    """(repository, root, commits, authors, created_in, created_at, created_by, modified_in, modified_at, modified_by) of files
    under all their names.

    ``changes``: (repository, file, commit_id, committed_at, author, walk); ``rooted``: (file, root), every name with the last of
    its chain. Created is the deepest commit of the walk, modified the shallowest, whatever their dates; of commits as deep the
    smallest id. Names meet over ``tasks`` tasks, and so do the changes of a file in a repository, if these are more than a
    shuffle has. Commits and authors are counted at their first row, which multiplies no rows as several distinct counts do.
    """
    row = F.struct("commit_id", "committed_at", "author")
    new = lambda c: F.col(c).isNotNull() & (F.row_number().over(W.partitionBy("repository", "root", c).orderBy("walk")) == 1)
    named = spread(spread(changes, tasks, "file").join(rooted, "file"), tasks, "repository", "root")
    rows = named.withColumn("new_commit", new("commit_id")).withColumn("new_author", new("author")).groupBy("repository", "root").agg(
        F.count_if("new_commit").alias("commits"), F.count_if("new_author").alias("authors"),
        F.min_by(row, F.struct((-F.col("walk")).alias("w"), "commit_id", "author")).alias("first"), F.min_by(row, F.struct("walk", "commit_id", "author")).alias("last"),
    )
    return rows.select("repository", "root", "commits", "authors", *_named("created", "first"), *_named("modified", "last"))
