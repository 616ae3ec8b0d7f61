"""Graph writer as set operations: declarations, opinions, retractions, edges, journal.

Each function takes the stored rows and a batch and returns the rows to append or the actions taken; stored rows are never
edited in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.opinions import LIVE


#: States of a generation that may still be published.
LIVE_GENERATIONS = ("planned", "ready", "running", "waiting_children", "retry_wait", "blocked")


def declare(nodes: DataFrame, batch: DataFrame) -> DataFrame:
    """(id, action): ``inserted`` where unknown, ``revived`` where removed; known live nodes give no row."""
    known = nodes.select("id", "removed")
    rows = batch.select("id").distinct().join(known, "id", "left")
    action = F.when(F.col("removed").isNull(), "inserted").when(F.col("removed"), "revived")
    return rows.select("id", action.alias("action")).where("action IS NOT NULL")


def state_opinions(stored: DataFrame, batch: DataFrame, identity: Sequence[str], fields: Sequence[str], order: str) -> DataFrame:
    """Actions per identity: unchanged, re-evidenced (same values), or opened, closing what was open.

    A batch that states an identity several times is applied in order: the last statement counts.
    """
    last = batch.withColumn("__n", F.row_number().over(W.partitionBy(*identity).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
    old = stored.where("state = 'open'").select(*identity, *[F.col(f).alias(f"old_{f}") for f in fields], F.col("id").alias("old_id"), F.col("evidence").alias("old_evidence"))
    new = last.select(*identity, *fields, "evidence", F.col("id").alias("new_id"))
    keys = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in identity]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    rows = new.alias("n").join(old.alias("o"), on, "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"n.{f}").eqNullSafe(F.col(f"o.old_{f}"))
    action = F.when(F.col("o.old_id").isNull(), "opened").when(~same, "replaced").when(~F.col("n.evidence").eqNullSafe(F.col("o.old_evidence")), "re-evidenced").otherwise("unchanged")
    return rows.select(*[F.col(f"n.{c}") for c in identity], F.col("n.new_id"), F.when(action == "replaced", F.col("o.old_id")).alias("closes"), action.alias("action"))


def merge_partial(stored: DataFrame, batch: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields a statement leaves out keep their stored values; evidence lists merge without repeats."""
    old = stored.select(key, *[F.col(f).alias(f"old_{f}") for f in fields], F.col("evidence").alias("old_evidence"))
    rows = batch.select(key, *fields, "evidence").join(old, key, "left")
    merged = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array("old_evidence", "evidence")))), ",")
    return rows.select(key, *[F.coalesce(f, f"old_{f}").alias(f) for f in fields], merged.alias("evidence"))


def retract(opinions: DataFrame, edges: DataFrame, producer: str) -> DataFrame:
    """(holder, closed, removed): the producer's open opinions close; a holder goes when nothing live and no edge remains."""
    mine = (F.col("producer") == producer) & (F.col("state") == "open")
    rows = opinions.groupBy("holder").agg(F.count(F.when(mine, 1)).alias("closed"), F.count(F.when(F.col("state").isin(*LIVE) & ~mine, 1)).alias("left"))
    ends = edges.select(F.col("holder"), F.lit(1).alias("held")).distinct()
    return rows.where("closed > 0").join(ends, "holder", "left").select("holder", "closed", ((F.col("left") == 0) & F.col("held").isNull()).alias("removed"))


def publish_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends resolved, or which end is missing."""
    live = nodes.where("NOT removed")
    a, b = live.select(F.col("id").alias("src"), F.lit(1).alias("a")), live.select(F.col("id").alias("dst"), F.lit(1).alias("b"))
    rows = edges.join(a, "src", "left").join(b, "dst", "left")
    missing = F.concat_ws("+", F.when(F.col("a").isNull(), "from"), F.when(F.col("b").isNull(), "to"))
    return rows.select("rel", "src", "dst", F.when(missing == "", "published").otherwise(missing).alias("outcome"))


def withdraw_edges(edges: DataFrame, stated: DataFrame, producer: str) -> DataFrame:
    """(rel, src, dst, closed, removed): edges that the producer stated; one goes when no other producer states it.

    ``stated`` has one row for each edge and producer.
    """
    key = ["rel", "src", "dst"]
    mine = F.col("producer") == producer
    held = stated.groupBy(*key).agg(F.count(F.when(mine, 1)).alias("closed"), F.count(F.when(~mine, 1)).alias("rest")).where("closed > 0")
    return edges.select(*key).join(held, key).select(*key, "closed", (F.col("rest") == 0).alias("removed"))


def stale(now: DataFrame, recorded: DataFrame, consumed: DataFrame) -> DataFrame:
    """(kind, reason): kinds whose members changed (``membership``) or their contents (``content``), and kinds that consume
    one of these (``consumed <kind>``, the first by name). ``now`` and ``recorded`` are membership digests."""
    old = recorded.select("kind", F.col("n").alias("old_n"), F.col("digest").alias("old_digest"))
    reason = F.when(~F.col("n").eqNullSafe(F.col("old_n")), "membership").when(~F.col("digest").eqNullSafe(F.col("old_digest")), "content")
    own = now.join(old, "kind", "full").select("kind", reason.alias("reason")).where("reason IS NOT NULL")
    by = consumed.join(own.select(F.col("kind").alias("of")), "of").groupBy("kind").agg(F.min("of").alias("of"))
    rows = own.join(by, "kind", "full")
    return rows.select("kind", F.coalesce("reason", F.concat(F.lit("consumed "), "of")).alias("reason"))


def recheck(generations: DataFrame, keys: DataFrame, reads: DataFrame, facts: DataFrame, published: DataFrame, consumed: DataFrame, run: object) -> DataFrame:
    """(generation, fresh, cause) of the generations that a run has to look at again.

    ``generations``: (generation, stage, run, state, inputs, versions) as they were recorded; ``keys``: (generation, inputs, versions)
    as they would be now; ``reads``: (generation, kind, key, digest) of what a generation read, the digest null where it found
    nothing; ``facts``: (kind, key, digest) as they stand; ``published``: (kind) that the run has published; ``consumed``: (stage, kind).

    Of the run's own generations, live ones are judged by their inputs and versions, published ones by every read too. Of
    other runs, published generations are looked at whose stage consumes a published kind: they stay fresh where nothing that
    they themselves read has moved. The cause names versions first, then inputs, then the first read by kind and key.
    Reads meet facts by key and are counted before they meet generations, so a generation of very many reads is spread.
    """
    now = keys.select("generation", F.col("inputs").alias("now_inputs"), F.col("versions").alias("now_versions"))
    stages = consumed.join(published.distinct(), "kind", "left_semi").select("stage").distinct().withColumn("reached", F.lit(True))
    own, live = F.col("run") == F.lit(run), F.col("state").isin(*LIVE_GENERATIONS)
    looked = generations.join(stages, "stage", "left").where((own & (live | (F.col("state") == "published"))) | (~own & (F.col("state") == "published") & F.col("reached")))
    looked = looked.join(now, "generation", "left")
    held = facts.select("kind", "key", F.col("digest").alias("now"))
    moved = reads.join(held, ["kind", "key"], "left").where(~F.col("digest").eqNullSafe(F.col("now")))
    how = F.when(F.col("digest").isNull(), "is no longer empty").when(F.col("now").isNull(), "is gone").otherwise("has moved")
    first = moved.groupBy("generation").agg(F.min(F.struct("kind", "key", how.alias("how"))).alias("read"))
    rows = looked.join(first, "generation", "left")
    cause = (
        F.when(~F.col("versions").eqNullSafe(F.col("now_versions")), "versions have moved").when(~F.col("inputs").eqNullSafe(F.col("now_inputs")), "inputs have moved")
        .when((F.col("state") == "published") & F.col("read").isNotNull(), F.concat(F.lit("read "), F.concat_ws(" ", "read.kind", F.col("read.key").cast("string"), "read.how")))
    )
    return rows.select("generation", cause.isNull().alias("fresh"), cause.alias("cause"))


def diff(current: DataFrame, wanted: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """(key, action): added, removed or changed; what is equal is left out."""
    c = current.select(key, F.struct(*values).alias("c"))
    w = wanted.select(key, F.struct(*values).alias("w"))
    rows = c.join(w, key, "full")
    action = F.when(F.col("c").isNull(), "added").when(F.col("w").isNull(), "removed").when(~F.col("c").eqNullSafe(F.col("w")), "changed")
    return rows.select(key, action.alias("action")).where("action IS NOT NULL")


def membership_digest(rows: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Order-free digest of each group's rows: their number and the sum of 48 bits of each row's SHA-256.

    Sums combine on the map side, so a group of any size is never gathered.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    part = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(part).cast("string").alias("digest"))


#: A statement of a page, named by the page and a name after the first ``#``.
STATEMENT = r"\A((?:product|domain):[a-z][a-z0-9-]*)#(?s:.+)\z"


def placed(items: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, slug, page): the pages that items (kind, slug, about: array of entries, asked_in) belong to.

    An entry names a statement, and so its page alone; or a page; or something that pages link to (``links``: page, entry).
    The page where an item was asked counts as well. Only pages of ``pages`` count; each is given once.
    """
    known = pages.select("page").distinct()
    each = items.select("kind", "slug", F.explode("about").alias("entry")).withColumn("of", F.regexp_extract("entry", STATEMENT, 1))
    each = each.withColumn("page", F.when(F.col("of") != "", F.col("of")).otherwise(F.col("entry")))
    named = each.join(known, "page", "left_semi").select("kind", "slug", "page")
    linked = each.where("of = ''").join(known, "page", "left_anti").drop("page").join(links.select("page", "entry").distinct(), "entry")
    asked = items.select("kind", "slug", F.col("asked_in").alias("page"))
    some = linked.select("kind", "slug", "page").unionByName(asked).join(known, "page", "left_semi")
    return named.unionByName(some.select("kind", "slug", "page")).distinct()


def waiting(items: DataFrame) -> DataFrame:
    """Questions (kind, status, resolved) that have an answer no statement has taken up, and open corrections."""
    question = (F.col("kind") == "question") & (F.col("status") == "answered") & ~F.coalesce("resolved", F.lit(False))
    return items.where(question | ((F.col("kind") == "correction") & (F.col("status") == "open")))


def refresh_reasons(pages: DataFrame, links: DataFrame, items: DataFrame, grounds: DataFrame, language_changed: bool = False) -> DataFrame:
    """(page, reason, ref): why pages must be written again. Pages without a row are unchanged.

    A change of language takes all pages; a ground (page, ground, status) that changed or is gone its page; an answer or a
    correction that waits the pages it belongs to (``placed``).
    """
    known = pages.select("page").distinct()
    moved = grounds.where("status IN ('changed', 'removed')").join(known, "page", "left_semi")
    out = moved.select("page", F.concat(F.lit("ground-"), F.col("status")).alias("reason"), F.col("ground").alias("ref"))
    said = placed(waiting(items), pages, links)
    out = out.unionByName(said.select("page", F.when(F.col("kind") == "question", "answer").otherwise(F.col("kind")).alias("reason"), F.col("slug").alias("ref")))
    if language_changed:
        out = out.unionByName(known.select("page", F.lit("language").alias("reason"), F.lit(None).cast("string").alias("ref")))
    return out.distinct()


def unplaced(pages: DataFrame, links: DataFrame, items: DataFrame) -> DataFrame:
    """The waiting items that belong to no page, whole."""
    open_ = waiting(items)
    return open_.join(placed(open_, pages, links), ["kind", "slug"], "left_anti").select(*items.columns)
