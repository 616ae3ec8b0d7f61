"""Benchmark decontamination by spaced seeds.

A seed is the hash of the tokens at a mask's positions; the positions between are ignored, so a seed still hits where
they were substituted. Test and training seeds are joined by hash; around every hit the two token sequences are aligned
without gaps, and the tokens themselves are compared one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, fresh, join_counted, materialize, pieces, spans, utf8
from .suffixes import _DOWN, _UP, _mix

U = np.uint64
STEP = 1 << 19
LONG = 4000
WINDOW, LEAST = 13, 11
#: Token positions; together they hit every alignment of 13 tokens with up to two substitutions.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+").findall
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, start and end of every token: maximal runs of ASCII letters and digits and non-ASCII bytes."""
    word = np.zeros(len(buf) + 2, bool)
    word[1:-1] = _WORD[buf]
    first = word[1:-1] & ~word[:-2]
    last = word[1:-1] & ~word[2:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(buf))]
    first[edge] = word[1:-1][edge]
    last[edge - 1] = word[1:-1][edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    out = np.empty(len(start), U)
    for s in range(0, len(buf), STEP):
        a, z = np.searchsorted(start, [s, s + STEP])
        if a == z:
            continue
        part = buf[s: min(len(buf), s + STEP + LONG)]
        q = np.zeros(len(part) + 1, U)
        np.cumsum((part.astype(U) + U(1)) * _UP[: len(part)], out=q[1:])
        i, j = start[a:z] - s, np.minimum(end[a:z] - s, len(part))
        out[a:z] = (q[j] - q[i]) * _DOWN[i]
    for t in np.flatnonzero(end - start > LONG):
        out[t] = xxhash.xxh64_intdigest(buf[start[t]: end[t]].tobytes())
    return _mix(out), doc, start, end


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def seeds(tok: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    n = len(tok) - mask[-1]
    if n <= 0:
        return np.zeros(0, U)
    h = np.full(n, number + 1, U)
    for o in mask:
        h = h * U(0x9E3779B97F4A7C15) + tok[o: o + n]
    return _mix(h)


def _mask(number: int) -> tuple[int, ...]:
    """The spaced seeds first, then those of items shorter than a window: their first one to four tokens."""
    return MASKS[number] if number < len(MASKS) else tuple(range(number - len(MASKS) + 1))


def _bench_seeds(items: DataFrame) -> DataFrame:
    """(seed, number, item, place, size) of all items: at every place of those of ``WINDOW`` tokens or more, else the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            tok, doc, _, _ = tokens(*utf8(_lower(b.column(1))))
            at = np.searchsorted(doc, np.arange(b.num_rows + 1))
            size = np.diff(at)
            for n in range(len(MASKS) + 4):
                m = _mask(n)
                h = seeds(tok, m, n)
                i = np.arange(len(h))
                mine = size[doc[i]]
                fits = mine >= WINDOW if n < len(MASKS) else (mine < WINDOW) & (np.minimum(mine, 4) == len(m)) & (i == at[doc[i]])
                i = i[fits & (doc[i] == doc[i + m[-1]])]
                d = doc[i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[i].view(np.int64)), pa.array(np.full(len(i), n, np.int32)), b.column(0).take(pa.array(d)), pa.array((i - at[d]).astype(np.int32)), pa.array(size[d].astype(np.int32))],
                    ["seed", "number", "item", "place", "size"],
                )

    return items.select("item", "text").mapInArrow(run, "seed long, number int, item long, place int, size int")


#: Shifts of a seed whose low bits each set a bit of the filter.
SHIFTS = (0, 12, 24, 36)


def _filter_bits(known: DataFrame, many: int, most: int) -> np.ndarray:
    """A filter of the seeds, four bits set for each: 64 bits a seed, ``most`` at most. One other seed in 65,000 passes; where
    the filter is too small, more do, and the join takes them out."""
    bits = 1 << max(12, min(most, 64 * max(many, 1)).bit_length() - 1)
    places = F.array(*[F.shiftrightunsigned("seed", x).bitwiseAND(F.lit(bits - 1)) for x in SHIFTS])
    low = known.select(F.explode(places).alias("low"))
    words = low.groupBy(F.shiftrightunsigned("low", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(low & 63 AS INT)))").alias("on")).toArrow()
    out = np.zeros(bits // 64, np.int64)  # at most ``most`` / 64 numbers reach the driver
    out[words["word"].to_numpy()] = words["on"].to_numpy()
    return out.view(U)


def _candidates(docs: DataFrame, known: DataFrame, many: int, most: int) -> DataFrame:
    """(row, doc_id, text, hits): the rows of ``docs`` with seeds that pass the filter, and those seeds with their places."""
    numbers = sorted(r[0] for r in known.select("number").distinct().collect())  # at most six
    shared = docs.sparkSession.sparkContext.broadcast(_filter_bits(known, many, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = shared.value
        least = U(64 * len(on) - 1)
        for b in pieces(batches):
            buf, offsets = utf8(_lower(b.column(1)))
            for i, j in spans(offsets, 4 << 20):
                tok, doc, _, _ = tokens(buf[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                first = np.searchsorted(doc, np.arange(j - i))
                found = []
                for n in numbers:
                    m = _mask(n)
                    h = seeds(tok, m, n)
                    p = np.arange(len(h))
                    for x in SHIFTS:
                        low = h[p] >> U(x) & least
                        p = p[(on[(low >> U(6)).astype(np.int64)] >> (low & U(63)) & U(1)).astype(bool)]
                    p = p[doc[p] == doc[p + m[-1]]]
                    found.append((doc[p], h[p], p - first[doc[p]]))
                d, h, p = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
                if not len(d):
                    continue
                order = np.argsort(d, kind="stable")
                rows, start = np.unique(d[order], return_index=True)
                at = pa.array(np.r_[start, len(d)].astype(np.int32))
                hits = pa.StructArray.from_arrays([pa.array(h[order].view(np.int64)), pa.array(p[order].astype(np.int32))], ["seed", "pos"])
                some = b.take(pa.array(rows + i))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.ListArray.from_arrays(at, hits)], ["doc_id", "text", "hits"])

    slim = docs.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    rows = slim.mapInArrow(run, f"doc_id {kind}, text string, hits array<struct<seed:long,pos:int>>")
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()))


def _alignments(rows: DataFrame, known: DataFrame, many: int, small: int) -> DataFrame:
    """Distinct (row, item, shift, size): where items would start in the rows' tokens, by the seeds that both have."""
    hits = rows.select("row", F.inline("hits"))
    slim = known.select("seed", "item", "place", "size")
    if many <= small:
        joined = hits.join(F.broadcast(slim), "seed")
    else:  # a frequent seed's rows are dealt over 16 keys
        salt = F.explode(F.sequence(F.lit(0), F.lit(15)))
        joined = hits.withColumn("salt", F.pmod(F.xxhash64("row", "pos"), F.lit(16)).cast("int")).join(slim.withColumn("salt", salt), ["seed", "salt"])
    return joined.select("row", "item", (F.col("pos") - F.col("place")).alias("shift"), "size").distinct()


def _words(text: str) -> list[bytes]:
    return _TOKEN(_lower(pa.array([text], pa.string()))[0].as_py().encode())


def overlap(mine: list[bytes], item: list[bytes], lead: int) -> tuple[int, int, int] | None:
    """Of an item and the tokens it is laid over, from its place ``lead`` on: first and last equal token of the windows of
    ``WINDOW`` places with ``LEAST`` equal tokens, and the equal tokens between. Shorter items must be equal as a whole."""
    n = len(item)
    same = [False] * n
    same[lead: lead + len(mine)] = [a == b for a, b in zip(mine, item[lead:])]
    w, need = (WINDOW, LEAST) if n >= WINDOW else (n, n)
    total = [0, *accumulate(same)]
    good = [j for j in range(n - w + 1) if total[j + w] - total[j] >= need]
    if not good:
        return None
    first, last = good[0] + same[good[0]:].index(True), good[-1] + w - 1
    while not same[last]:
        last -= 1
    return first, last, total[last + 1] - total[first]


def _verified(rows: DataFrame, at: DataFrame, items: DataFrame) -> DataFrame:
    """(row, doc_id, item, item_id, size, first_token, n_tokens, n_equal) of the alignments that hold, tokens compared."""
    kind, item_kind = rows.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    lists = at.groupBy("row").agg(F.collect_list(F.struct("item", "shift", "size")).alias("wanted"))
    texts = rows.select("row", "doc_id", "text").join(lists, "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, wanted = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)
            for i, text in enumerate(texts):
                words, want = _words(text), wanted[i].values
                shift, size = want.field(1).to_pylist(), want.field(2).to_pylist()
                for a in range(0, len(want), 4096):
                    z = min(len(want), a + 4096)
                    pieces = [b" ".join(words[max(s, 0): max(s + n, 0)]).decode() for s, n in zip(shift[a:z], size[a:z])]
                    names = b.column(1).slice(i, 1).take(pa.array([0] * (z - a)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[i]] * (z - a), pa.int64()), names, want.field(0).slice(a, z - a), want.field(1).slice(a, z - a), pa.array(pieces, pa.string())], ["row", "doc_id", "item", "shift", "piece"]
                    )

    pieces = materialize(texts.mapInArrow(cut, f"row long, doc_id {kind}, item long, shift int, piece string"))
    counts = pieces.groupBy("item").agg(F.count(F.lit(1)).alias("many"))
    laid = join_counted(pieces, materialize(items.join(counts, "item").select("item", "item_id", F.col("text").alias("whole"), "many")), "item")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[bytes]] = {}
        for b in batches:
            keep, first, n, equal, sizes = [], [], [], [], []
            item, shift, piece, whole = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("item", "shift", "piece", "whole"))
            for i in range(b.num_rows):
                if item[i] not in known:
                    if len(known) >= 1_000:
                        known.clear()
                    known[item[i]] = _words(whole[i])
                words = known[item[i]]
                got = overlap(piece[i].encode().split(b" ") if piece[i] else [], words, max(-shift[i], 0))
                if got:
                    keep.append(i)
                    first.append(shift[i] + got[0])
                    n.append(got[1] - got[0] + 1)
                    equal.append(got[2])
                    sizes.append(len(words))
            some = b.select(["row", "doc_id", "item", "item_id"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array(x, pa.int64()) for x in (sizes, first, n, equal))], ["row", "doc_id", "item", "item_id", "size", "first_token", "n_tokens", "n_equal"])

    return laid.mapInArrow(compare, f"row long, doc_id {kind}, item long, item_id {item_kind}, size long, first_token long, n_tokens long, n_equal long")


def _overlaps(docs: DataFrame, benchmark: DataFrame, filter_bits: int, small: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` that may overlap with an item, and the alignments that do."""
    some = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    items = materialize(some.withColumn("item", F.monotonically_increasing_id()))
    known = materialize(_bench_seeds(items))
    many = known.count()
    rows = _candidates(docs, known, many, filter_bits)
    return rows, _verified(rows, _alignments(rows, known, many, small), items)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, filter_bits: int = 1 << 28, small: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, first_token, n_tokens, n_equal, similarity: the best alignment of each row and item that overlap.

    Texts are lower-cased; tokens are runs of letters and digits. Some 13 aligned tokens must have 11 equal ones; of items
    of fewer tokens all must be equal, in order. Rows without overlap give no rows; neither do null and empty texts or
    items, nor empty tables. Rows that repeat an id give their own results, a null doc_id keeps its row; repeated items of
    one id and text are one. Best: most equal tokens, then the first place.

    Test and training seeds are joined by hash. Before, a filter of at most ``filter_bits`` bits thins the training seeds
    where the texts lie; up to ``small`` test seeds (32 bytes each) are broadcast to the join, of more both sides are shuffled.
    """
    _, found = _overlaps(docs, benchmark, filter_bits, small)
    best = F.min(F.struct((-F.col("n_equal")).alias("less"), "first_token", "n_tokens", "n_equal")).alias("b")
    each = found.groupBy("row", "doc_id", "item", "item_id").agg(best)
    return each.select("doc_id", "item_id", "b.first_token", "b.n_tokens", "b.n_equal", (F.col("b.n_equal") / F.col("b.n_tokens")).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_tokens: int = 8, filter_bits: int = 1 << 28, small: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that overlap with no test item of ``least_tokens`` tokens or more, all columns as they were.

    Shorter items are only reported by ``find_overlaps``: whole documents don't go for a few common words. Overlap is a
    matter of the text alone, so rows go by their texts' MD5; null and empty texts stay, as do rows whose item is null.
    """
    rows, found = _overlaps(docs, benchmark, filter_bits, small)
    gone = found.where(F.col("size") >= least_tokens).select("row").distinct()
    sums = materialize(rows.join(gone, "row").select(F.md5(F.col("text").cast("binary"))).distinct())
    key = fresh(docs, "__sum")
    return among(docs.withColumn(key, F.md5(F.col("text").cast("binary"))), key, sums, "left_anti").drop(key)
