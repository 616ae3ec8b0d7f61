"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base patterns (assignments, access keys, long hex) are reported wherever they occur. Beside them, free-standing
credential-like strings are candidates; a candidate becomes a finding only when the whole corpus shows it to be
specific to few repositories and owners. Strings copied through many repositories are examples, not credentials.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize

# The base patterns and their shortest reported lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
# AKIA[A-Z0-9]+ of 16 or more, and [0-9a-f]+ of 32 or more: with the length inside the pattern, the same maximal runs match.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Free-standing candidates: known prefixes of issued tokens.
TOKEN = r"(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{30,}|glpat-[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
KINDS = ("assign", "access", "hex", "token")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a lambda's variable isn't evaluated again at each mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _starts(lengths: Column) -> Column:
    """Running sums before each element. ``aggregate`` copies its array at each step, so it runs over blocks of about the
    square root of their number, and then over the blocks' sums."""

    def before(xs: Column) -> Column:
        # the sums so far, the last of which is the total
        zero = F.array(F.lit(0).cast("long"))
        return F.aggregate(xs, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def joined(blocks: Column) -> Column:
        bases = before(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return F.flatten(F.zip_with(blocks, F.slice(bases, 1, F.size(blocks)), lambda b, base: F.transform(F.slice(b, 1, F.size(b) - 1), lambda x: x + base)))

    size = lambda xs: F.greatest(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(1))
    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), size(xs)), lambda i: before(F.slice(xs, i + 1, size(xs))))
    return _let(lengths, lambda xs: _let(cut(xs), joined))


def _found(text: Column, pattern: str, kind: str, value_group: int | None = None, least: int = 0) -> Column:
    """array<struct<s,e,k,kind,v>>: each match's code point span and value.

    Spark has no function that gives positions: the pieces between matches (split) and the matches themselves
    alternate, so their running lengths are the positions.
    """
    k = KINDS.index(kind)
    none = F.from_json(F.lit("[]"), "array<struct<s:int,e:int,k:int,kind:string,v:string>>")

    def placed(matches: Column, pieces: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else matches
        # the last piece has no match after it
        ends = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: (F.length(p) + F.length(m)).cast("long"))
        rows = F.arrays_zip(_starts(ends).alias("at"), pieces.alias("p"), matches.alias("m"), values.alias("v"))
        start = lambda x: (x["at"] + F.length(x["p"])).cast("int")
        item = lambda x: F.struct(start(x).alias("s"), (start(x) + F.length(x["m"])).alias("e"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), x["v"].alias("v"))
        return F.transform(F.filter(rows, lambda x: x["m"].isNotNull() & (F.length(x["v"]) >= least)), item)

    every = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: _let(F.split(text, pattern, -1), lambda pieces: placed(matches, pieces)))
    return F.when(text.rlike(pattern), every).otherwise(none)


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(spans, lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).otherwise(a["k"] - b["k"]))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "doc_id",
    owner_col: str = "source",
    max_repos: int = 2,
    max_owners: int = 1,
) -> DataFrame:
    """One row per input row: base counts, spans, and how widely the document's candidate values are owned.

    A value's repositories and owners are counted over the whole corpus (distinct (value, repository) pairs first,
    so a value in a third of all rows is pre-aggregated on the map side). ``live`` counts findings whose value has
    at most ``max_repos`` repositories and ``max_owners`` owners; ``copied`` the others. Free-standing tokens are
    added to ``spans`` only when live. A corpus without repositories takes its documents for them and their source for
    the owner (the defaults): a value in three documents is copied, even if one source holds them all, and so is one of
    two sources. Null text counts as empty; a null repository or owner is one of its own. Repeated ids keep one row each
    and are one repository. An empty table gives no rows. Values leave the operator only as hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(_found(text, ASSIGN, "assign", 2, ASSIGN_LEAST), _found(text, ACCESS, "access"), _found(text, HEX, "hex"))
    free = _found(text, TOKEN, "token")
    hashed = lambda spans: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["kind"].alias("kind"), F.sha2(x["v"], 256).alias("h")))
    # one pass over the texts; what it finds is narrow, and is read twice below
    found = materialize(
        docs.select(
            F.col(id_col).alias("id"), F.coalesce(F.col(repo_col).cast("string"), F.lit("\0null")).alias("repo"),
            F.coalesce(F.col(owner_col).cast("string"), F.lit("\0null")).alias("owner"), F.expr("uuid()").alias("row"), hashed(base).alias("base"), hashed(free).alias("free"),
        )
    )
    some = found.where((F.size("base") > 0) | (F.size("free") > 0))
    # one row a finding; base spans (k below that of tokens) are reported anyway and only counted
    items = materialize(some.select("row", "repo", "owner", F.inline(F.concat("base", "free"))).withColumn("free", F.col("k") == KINDS.index("token")))
    # counts of distinct pairs, never lists: a value's repositories may be a third of all rows
    repos = items.groupBy("h", "repo").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("many"))
    owners = items.groupBy("h", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.count(F.lit(1)).alias("owners"))
    # live values are in few repositories; only rows that repeat an id can make one of them frequent
    live = materialize(repos.join(owners, "h").where((F.col("repos") <= max_repos) & (F.col("owners") <= max_owners)).select("h", "many"))
    # the copied ones' rows, however many, aren't shuffled to one place: they find no partner in the rest's join
    frequent = materialize(repos.where(F.col("repos") > max_repos).select("h", "many"))
    total = items.count()
    few = frequent.where(F.col("many") * 1000 > total).select("h")  # fewer than 1,000 values
    left = items.select("row", "h", "free", "s", "e", "k", "kind").join(F.broadcast(few), "h", "left_anti")
    span = F.when(F.col("free"), F.struct("s", "e", "k", "kind"))
    per_row = join_counted(left, live, "h").groupBy("row").agg(F.count(F.lit(1)).alias("n_live"), F.collect_list(span).alias("live_free"))
    out = found.join(per_row, "row", "left")
    plain = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["kind"].alias("kind")))
    every = F.when(F.col("live_free").isNull(), plain).otherwise(F.concat(plain, "live_free"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    n_live = F.coalesce("n_live", F.lit(0).cast("long"))
    return out.select(
        F.col("id").alias(id_col), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(plain), 256).alias("base_sha256"), _joined(every).alias("spans"),
        n_live.alias("n_live"), (F.size("base") + F.size("free") - n_live).cast("long").alias("n_copied"),
    )
