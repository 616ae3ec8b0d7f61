"""Spelling variants: pairs of words one edit apart, found by a positional 2-gram index, and the forms they vary.

Words of m and m' characters one edit apart share at least max(m, m') - 3 grams, each at the same place or, where one character
was inserted before it, one place on. All grams are ordered by how rare they are. Of the four rarest of each word at most two
are spoilt by the edit, so both words have two grams in common among these: every word is sent to the keys of the pairs of its
four rarest grams with their places and its length. What meets under a key is indexed there by gram and place; for every word
its postings are merged by a heap, words met often enough are kept, and these are compared letter by letter.
"""

from __future__ import annotations

import collections
import heapq
import itertools
import string
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import chains

from .common import materialize

# Runs of letters, and how often and where one loses a letter.
RUN = "[A-Za-zÀ-ÿ]+"
EVERY = 199
#: Grams of a word that its keys are made of.
RAREST = 4
ROUTED = "key long, word string, n long, longer boolean, a int, b int"
NEAR = "word string, near string, near_n long"


def count_words(docs: DataFrame, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n) of the runs of letters in all texts, of ``shortest`` characters and ``least`` occurrences or more.

    Only A-Z are lower-cased. A run whose crc32 of ``doc_id:run`` is divisible by 199 loses the character that it points at.
    A null doc_id is written as no characters; null texts have no runs. Counts combine before the shuffle.
    """
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    hashed = runs.select("run", h.alias("h")).select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return hashed.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: collections.Counter = collections.Counter()
    for b in batches:
        for w in b.column(0).to_pylist():
            counts.update(map("".join, zip(w, w[1:])))
    yield pa.RecordBatch.from_pydict({"gram": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})


def gram_order(words: DataFrame) -> dict[str, int]:
    """The place of every 2-gram by its number of occurrences, rarest first.

    The letters of ``RUN`` (lower-cased) make at most 8,100 grams, whatever the input: the table may go through the driver.
    """
    grams = words.select("word").mapInArrow(_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: i for i, r in enumerate(sorted(grams.collect(), key=lambda r: (r["n"], r["gram"])))}


def rarest(word: str, order: dict[str, int], most: int = RAREST) -> list[tuple[int, int]]:
    """(gram's number, place) of the rarest grams of a word, rarest first."""
    return heapq.nsmallest(most, ((order[word[i: i + 2]], i) for i in range(len(word) - 1)))


def _mixed(columns: Sequence[np.ndarray]) -> np.ndarray:
    """One 64-bit key of several numbers. Keys that fall together only add candidates."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def route(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """(key, word, n, longer, a, b): each word under the keys of its gram pairs, whose places in it are ``a`` and ``b``.

    A key names two grams, their places and a length, as the shorter of two words has them. A word stands under its own keys
    (as long as the other, or the shorter), and as the ``longer`` under those of a word that lacks one of its characters:
    both grams before that character, one of them, or neither.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2_000):
                some = b.slice(start, 2_000)
                rows = []
                for i, w in enumerate(some.column(0).to_pylist()):
                    m = len(w)
                    for (g, x), (h, y) in itertools.combinations(rarest(w, order), 2):
                        rows.append((i, g, x, h, y, m, 0, x, y))
                        between = (1, 0) if x > y else (0, 1)
                        for dx, dy in ((0, 0), between, (1, 1)):
                            if x >= dx and y >= dy:
                                rows.append((i, g, x - dx, h, y - dy, m - 1, 1, x, y))
                if not rows:
                    continue
                at, g, x, h, y, m, longer, a, b_ = np.array(rows, np.int64).T
                took = some.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_mixed([g, x, h, y, m])), took.column(0), took.column(1), pa.array(longer.astype(bool)), pa.array(a.astype(np.int32)), pa.array(b_.astype(np.int32))],
                    names=["key", "word", "n", "longer", "a", "b"],
                )

    return words.select("word", "n").mapInArrow(keys, ROUTED)


def one_edit(s: str, t: str) -> bool:
    """Whether exactly one character replaced, or inserted into ``s``, makes ``t``."""
    if len(s) == len(t):
        i = next((i for i, (x, y) in enumerate(zip(s, t)) if x != y), None)
        return i is not None and s[i + 1:] == t[i + 1:]
    i = next((i for i, (x, y) in enumerate(zip(s, t)) if x != y), len(s))
    return s[i:] == t[i + 1:]


def merged(postings: list[list[int]], least: int) -> Iterator[int]:
    """Numbers that stand in ``least`` or more of the sorted lists, by a heap over the lists' heads."""
    if len(postings) < least:
        return
    if len(postings) == 1:
        yield from postings[0]
        return
    for number, same in itertools.groupby(heapq.merge(*postings)):
        if least == 1 or sum(1 for _ in same) >= least:
            yield number


def near_in(rows: list[tuple[str, int, bool, int, int, int]], apart: bool) -> Iterator[tuple[str, int, str, int]]:
    """(word, n, near, near_n) among the rows (word, n, longer, a, b, block) of one key.

    All share two grams already; the others have to make up the bound. ``apart``: the rows are those of two blocks of a large
    key, and only pairs across the blocks are looked for.
    """
    longs: dict[tuple[str, int], list[int]] = collections.defaultdict(list)
    for i, (w, _, longer, a, b, _) in enumerate(rows):
        if longer:
            for p in range(len(w) - 1):
                if p != a and p != b:
                    longs[w[p: p + 2], p].append(i)
    even: dict[tuple[str, int], list[int]] = collections.defaultdict(list)
    for i, (w, n, longer, a, b, block) in enumerate(rows):
        if longer:
            continue
        m = len(w)
        grams = [(w[p: p + 2], p) for p in range(m - 1) if p != a and p != b]
        found = list(merged([even[g] for g in grams if g in even], m - 5))
        if longs:
            moved = ((g, p + d) for g, p in grams for d in (0, 1))
            found += merged([longs[x] for x in moved if x in longs], m - 4)
        for j in found:
            t, t_n, _, _, _, other = rows[j]
            if not (apart and other == block) and one_edit(w, t):
                yield w, n, t, t_n
        for g in grams:
            even[g].append(i)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut where the key changes, so that all rows of a key are in one piece."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "low", "high")]
        change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        if held and any(held[-1].column(c)[-1].as_py() != b.column(c)[0].as_py() for c in ("key", "low", "high")):
            yield from _joined(held)
            held = []
        if len(change):
            held.append(b.slice(0, change[-1]))
            yield from _joined(held)
            held = []
            b = b.slice(change[-1])
        held.append(b)
    if held:
        yield from _joined(held)


def _joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _runs(batches):
        n = b.num_rows
        keys = [b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "low", "high")]
        starts = np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1, [n]])
        shorter = np.concatenate([[0], np.cumsum(~b.column("longer").to_numpy(zero_copy_only=False))])
        some = np.flatnonzero((np.diff(starts) > 1) & (np.diff(shorter[starts]) > 0))
        if not len(some):
            continue
        rows = list(zip(*[b.column(c).to_pylist() for c in ("word", "n", "longer", "a", "b", "mine")]))
        out = []
        for i in some:
            apart = keys[1][starts[i]] != keys[2][starts[i]]
            for s, s_n, t, t_n in near_in(rows[starts[i]: starts[i + 1]], bool(apart)):
                out += ((s, t, t_n), (t, s, s_n))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.int64()))], names=["word", "near", "near_n"])


def near_words(words: DataFrame, block: int = 2_000) -> DataFrame:
    """(word, near, near_n), both ways round, of all pairs of words (word, n) exactly one edit apart.

    A key of more than ``block`` rows is dealt over blocks, and each pair of blocks is a key: no task gets more than two
    blocks of it, and all pairs still meet. A word of very many neighbours has no place of its own: its pairs are found under
    many keys. Words are at least six characters long, so that near ones have three grams in common: two make the key, and the
    index counts the others. A pair may be found under several keys and is given once.
    """
    order = gram_order(words)
    routed = materialize(route(words, order))
    large = materialize(routed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > block).select("key", F.ceil(F.col("many") / block).cast("int").alias("blocks")))
    zero = F.lit(0)
    rest = routed
    dealt = None
    if (n := large.count()):
        large = F.broadcast(large) if n <= 100_000 else large
        rest = routed.join(large.select("key"), "key", "left_anti")
        mine = routed.join(large, "key").withColumn("mine", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
        mine = mine.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        dealt = mine.select(*routed.columns, "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    rows = rest.withColumns({"mine": zero, "low": zero, "high": zero})
    rows = rows.unionByName(dealt) if dealt is not None else rows
    found = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_near, NEAR)
    return found.repartition("word").distinct()


def spelling_variants(docs: DataFrame, shortest: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of documents (doc_id, text).

    ``form``: the near word (exactly one edit apart) of the largest n, the smaller by code points of equal ones, if that n is
    ``times`` the word's or more. ``root``: the last of the forms of forms. Each form occurs several times as often as its word, so
    chains are short and have no circles; they are followed by pointer doubling. Null texts and an empty table give no words.
    """
    if shortest < 6:
        raise ValueError("words of fewer than six characters may have only two grams in common with a near word")
    words = materialize(count_words(docs, shortest, least))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("best"))
    best = F.col("best")
    enough = -best["m"] >= F.col("n") * times
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, best["near"]).alias("form"), F.when(enough, -best["m"]).alias("form_n")
    )
    rows = materialize(rows)
    roots = chains(rows.where("form IS NOT NULL").select(F.col("word").alias("src"), F.col("form").alias("dst"))).select(F.col("id").alias("word"), "root")
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
