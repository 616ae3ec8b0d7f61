"""SimHash near-duplicates: fingerprints, bit-sliced comparison, linked classes.

A batch of fingerprints is stored vertically: plane p holds bit p of every fingerprint, 64 to a word. XOR of a plane
with itself shifted by d positions compares every fingerprint with the one d places on at once; a carry-save counter
adds the differing bits of 64 comparisons per word. The counter starts at 2^k - (radius + 1), so its carry out marks
the comparisons that exceed the radius, and a block is abandoned once all of its comparisons do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, join_counted, materialize, partitions, pieces
from .components import components

SEED = 42
CHUNK = 1 << 16
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


# -- fingerprints


def shingle_hashes(text: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 of the k-word shingles of a text, in chunks; a text of fewer words is one shingle, an empty one none."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white spaces
    h = xxhash.xxh64_intdigest
    if 0 < len(words) < k:
        words, k = [b" ".join(words)], 1
    for i in range(0, len(words) - k + 1, CHUNK):
        part = words[i: i + CHUNK + k - 1]
        if k == 1:
            yield np.array([h(w, SEED) for w in part], np.uint64)
        else:
            yield np.array([h(b" ".join(t), SEED) for t in zip(*(part[j:] for j in range(k)))], np.uint64)


def majority(chunks: Iterator[np.ndarray], words: int = 1) -> np.ndarray:
    """The fingerprint of ``words`` x 64 bits: a bit is 1 if set in over half the hashes; no hashes give zero.

    Word 0 takes the hashes as they are, later words take them mixed with another constant.
    """
    total, n = np.zeros((words, 64), np.int64), 0
    for h in chunks:
        n += len(h)
        for w in range(words):
            x = h
            if w:
                x = (h ^ (h >> np.uint64(31))) * _ODD[w]
                x ^= x >> np.uint64(29)
            total[w] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > n, axis=1, bitorder="little").view(np.uint64).ravel()


class Minima:
    """Smallest values of ``BANDS * ROWS`` mixes of a text's shingle hashes, as keys of ``ROWS`` of them.

    Two texts share a mix's minimum with the probability of their shingle sets' similarity.
    """

    BANDS, ROWS = 8, 3

    def __init__(self, seed: int = 7):
        many = self.BANDS * self.ROWS
        self.odd = np.random.default_rng(seed).integers(0, 2**63, (many, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.least = np.full(many, np.uint64(0xFFFFFFFFFFFFFFFF))

    def watch(self, chunks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        self.least[:] = np.uint64(0xFFFFFFFFFFFFFFFF)
        for h in chunks:
            x = h ^ (h >> np.uint64(32))
            for i in range(0, len(x), 4096):
                y = x[i: i + 4096] * self.odd
                np.minimum(self.least, (y ^ (y >> np.uint64(29))).min(axis=1), out=self.least)
            yield h

    def keys(self) -> np.ndarray:
        least, key = self.least.reshape(-1, self.ROWS), np.arange(1, self.BANDS + 1, dtype=np.uint64)
        for j in range(self.ROWS):
            key = (key ^ least[:, j]) * _ODD[j]
            key ^= key >> np.uint64(32)
        return key


def fingerprints(docs: DataFrame, k: int = 3, words: int = 1, keys: bool = False) -> DataFrame:
    """id, f0.. (longs) and, with ``keys``, the array ``band`` of keys that similar texts share. Map-only."""
    names = [f"f{i}" for i in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = Minima()
        for b in pieces(batches):
            prints, minima = [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(text or b"", k)
                prints.append(majority(least.watch(hashes) if keys else hashes, words))
                if keys:
                    minima.append(least.keys())
            x = np.array(prints, np.uint64).reshape(-1, words).view(np.int64)
            cols = [pa.array(np.ascontiguousarray(x[:, i])) for i in range(words)]
            if keys:
                y = np.array(minima, np.uint64).reshape(-1, Minima.BANDS).view(np.int64)
                cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * Minima.BANDS), pa.array(y.ravel())))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", *names, *(["band"] if keys else [])])

    slim = docs.select(F.col("doc_id").alias("id"), "text")
    more = ", band array<long>" if keys else ""
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names) + more)


# -- comparison


def _planes(f: np.ndarray) -> np.ndarray:
    """(bits, words): plane p, bit i = bit p of fingerprint i; two words of zeros follow."""
    n, w = f.shape
    bits = np.unpackbits(f.view(np.uint8).reshape(n, 8 * w), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    out = np.zeros((64 * w, -(-n // 64) + 2), np.uint64)
    out.view(np.uint8)[:, : packed.shape[1]] = packed
    return out


def _pack(mask: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words, np.uint64)
    packed = np.packbits(mask, bitorder="little")
    out.view(np.uint8)[: len(packed)] = packed
    return out


def close(planes: np.ndarray, lag: int, valid: np.ndarray, radius: int, block: int = 1024) -> np.ndarray:
    """Positions i whose fingerprint differs from that at i + lag in at most ``radius`` bits, where ``valid``."""
    words = -(-len(valid) // 64)
    q, r = divmod(lag, 64)
    counters = (radius + 1).bit_length() if (radius + 1) & radius else radius.bit_length()
    bias = 2**counters - (radius + 1)
    every = _pack(valid, words)
    found = []
    for a in range(0, words, block):
        z = min(words, a + block)
        over = ~every[a:z]
        count = [np.full(z - a, np.uint64(0xFFFFFFFFFFFFFFFF) if bias >> j & 1 else np.uint64(0)) for j in range(counters)]
        for p0 in range(0, len(planes), 8):
            here = planes[p0: p0 + 8]
            ahead = here[:, a + q: z + q] >> np.uint64(r)
            if r:
                ahead = ahead | here[:, a + q + 1: z + q + 1] << np.uint64(64 - r)
            for x in here[:, a:z] ^ ahead:
                for j in range(counters):
                    carry = count[j] & x
                    count[j] ^= x
                    x = carry
                over |= x
            if (over == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
                break
        hit = np.flatnonzero(np.unpackbits((~over).view(np.uint8), bitorder="little"))
        found.append(hit + 64 * a)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def link(key: np.ndarray, f: np.ndarray, radius: int, compared: bool = False) -> np.ndarray:
    """Edges (i, j), at most n - 1 per group of equal keys, that connect what is linked within the group.

    Every pair within a group is compared, except in groups that are already one class. With ``compared``, each edge is
    a pair that is itself within the radius.
    """
    n = len(key)
    pairs = []
    root = np.arange(n)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, n])
    group = np.repeat(np.arange(len(start)), size)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def flat() -> None:
        while True:
            up = root[root]
            if (up == root).all():
                return
            root[:] = up

    lag, rebuild = 0, True
    while True:
        if rebuild:
            flat()
            classes = np.bincount(group[root == np.arange(n)], minlength=len(start))
            left = np.flatnonzero((classes > 1) & (size > lag + 1))
            if not len(left):
                break
            left = left[np.argsort(-size[left], kind="stable")]
            rows = np.concatenate([np.arange(start[g], start[g] + size[g]) for g in left])
            sizes, planes = size[left], _planes(np.ascontiguousarray(f[rows]))
            ends = np.cumsum(sizes)
            mine = group[rows]
        lag += 1
        groups = int(np.searchsorted(-sizes, -lag, side="left"))  # those with more than ``lag`` rows come first
        if not groups:
            break
        m = int(ends[groups - 1]) - lag
        hit = close(planes, lag, mine[:m] == mine[lag: m + lag], radius)
        if len(hit):
            a, b = rows[hit], rows[hit + lag]
            flat()
            apart = root[a] != root[b]
            for x, y in zip(a[apart].tolist(), b[apart].tolist()):
                i, j = top(x), top(y)
                if i != j:
                    root[max(i, j)] = min(i, j)
                    pairs.append((x, y))
        rebuild = lag & (lag - 1) == 0
    if compared:
        return np.array(pairs, np.int64).reshape(-1, 2)
    flat()
    moved = np.flatnonzero(root != np.arange(n))
    return np.column_stack([moved, root[moved]])


def across(key: np.ndarray, f: np.ndarray, kind: np.ndarray, radius: int, nearest: bool = False) -> Iterator[np.ndarray]:
    """All pairs (i, j) of rows of equal, sorted keys and different kinds within the radius, or each row's nearest of them.

    Every row outside its group's largest kind is compared with all rows of the group: few, once most are of one kind.
    """
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    for a, z in zip(start, np.r_[start[1:], len(key)]):
        names, mine = np.unique(kind[a:z], return_inverse=True)
        if len(names) < 2:
            continue
        g = f[a:z]
        small = mine != np.bincount(mine).argmax()
        best, to = np.full(z - a, radius + 1), np.zeros(z - a, np.int64)
        for i in np.flatnonzero(small):
            far = np.bitwise_count(g ^ g[i]).sum(1)
            # of two rows outside the largest kind, the later one finds the pair
            j = np.flatnonzero((far <= radius) & (mine != mine[i]) & (~small | (np.arange(z - a) < i)))
            if nearest:
                closer = j[far[j] < best[j]]
                best[closer], to[closer] = far[closer], i
                if len(j) and far[j].min() < best[i]:
                    best[i], to[i] = far[j].min(), j[far[j].argmin()]
            elif len(j):
                yield np.column_stack([j, np.full(len(j), i)]) + a
        if nearest:
            i = np.flatnonzero(best <= radius)
            yield np.column_stack([i, to[i]]) + a


def _links(keyed: DataFrame, words: int, radius: int, compared: bool = False, kind: str | None = None, nearest: bool = False) -> DataFrame:
    """Edges (a, b) between ids of rows with equal keys and close fingerprints: those of ``link``, or, with the name of a
    column of longs, those of ``across``."""
    cols = [f"f{i}" for i in range(words)] + ([kind] if kind else [])

    def edges(key, ids, f):
        order = np.lexsort((f[:, 0], key))
        key, ids, f = key[order], ids[order], f[order]
        # rows alone with their key have nothing to be compared with
        same = np.r_[False, key[1:] == key[:-1]]
        some = same | np.r_[same[1:], False]
        key, ids, f = key[some], ids[some], f[some]
        for e in across(key, f[:, :words], f[:, words], radius, nearest) if kind else [link(key, f, radius, compared)]:
            yield pa.RecordBatch.from_arrays([pa.array(ids[e[:, 0]]), pa.array(ids[e[:, 1]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        many = 0
        for b in batches:
            if not b.num_rows:
                continue
            f = np.column_stack([b.column(2 + i).to_numpy() for i in range(len(cols))]).view(np.uint64)
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), f))
            many += b.num_rows
            if many >= 100_000:
                key, ids, f = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(key, key[-1], side="left"))  # the last key may go on
                if cut:
                    yield from edges(key[:cut], ids[:cut], f[:cut])
                held, many = [(key[cut:], ids[cut:], f[cut:])], len(key) - cut
        if held:
            yield from edges(*(np.concatenate(x) for x in zip(*held)))

    n = 2 * partitions(keyed.sparkSession)
    dealt = keyed.select("key", "id", *cols).repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def _masked(column: str, masks: list[int], seed: int) -> Column:
    signed = lambda m: m - 2**64 if m >> 63 else m
    return F.array(*[F.xxhash64(F.lit(seed), F.lit(t), F.col(column).bitwiseAND(F.lit(signed(m)).cast("long"))) for t, m in enumerate(masks)])


def _rows_by_key(prints: DataFrame, words: int, keys: Column, *more: str) -> tuple[DataFrame, DataFrame]:
    """Rows (t, key, id, f.., ``more``), one for each of ``keys``, and (key, many) of all keys of more than one row."""
    cols = ["id", *(f"f{i}" for i in range(words)), *more]
    rows = prints.select(*prints.columns, F.posexplode(keys).alias("t", "key")).select("t", "key", *cols)
    return rows, rows.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")


def _refined(prints: DataFrame, words: int, keys: Column, finer: Column, hot: int) -> DataFrame:
    """Rows (key, id, f..), one for each of ``keys``. A key of more than ``hot`` rows is replaced by the ``finer`` ones,
    which depend on the key and its number ``t`` and lose no pair within the radius."""
    rows, counts = _rows_by_key(prints, words, keys)
    # of n rows there are at most n / hot such keys
    large = materialize(counts.where(F.col("many") > hot).select("key"))
    cols = [c for c in rows.columns if c not in ("t", "key")]
    refined = among(rows, "key", large).select(*cols, F.explode(finer).alias("key"))
    return among(rows, "key", large, "left_anti").select(*cols, "key").unionByName(refined.select(*cols, "key"))


def _in_blocks(prints: DataFrame, words: int, keys: Column, hot: int, *more: str) -> DataFrame:
    """Rows (key, id, f.., ``more``), one for each of ``keys``. The rows of a key of more than ``hot`` are dealt over blocks
    of about ``hot`` rows, and each pair of blocks gets a key of its own: every pair of rows still meets, and no key has
    many more than 2 * ``hot`` rows."""
    rows, counts = _rows_by_key(prints, words, keys, *more)
    rows, counts = materialize(rows), materialize(counts)
    large = counts.where(F.col("many") > hot)  # of n rows at most n / hot keys
    cols = [c for c in rows.columns if c not in ("t", "key")]
    few = among(rows, "key", large.select("key"), "left_anti").select("key", *cols)
    n = F.ceil(F.col("many") / hot).cast("int")
    split = join_counted(rows, large.withColumn("n", n), "key").withColumn("mine", F.pmod(F.xxhash64(F.lit("block"), "id"), F.col("n")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pair = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    return few.unionByName(split.select(pair.alias("key"), *cols))


def block_keys(column: str) -> tuple[Column, Column]:
    """Exact keys for up to two differing bits.

    Of four 16-bit blocks at least two agree: six keys of 32 bits. A key with very many fingerprints is refined: of
    the other 32 bits' four 8-bit blocks again at least two agree, and a refined key, of 48 bits, holds at most 2^16.
    """
    first, second = [], []
    for t, pair in enumerate(combinations(range(4), 2)):
        mask = sum(0xFFFF << 16 * i for i in pair)
        first.append(mask)
        rest = [8 * i for i in range(8) if i // 2 not in pair]
        finer = [mask | sum(0xFF << s for s in two) for two in combinations(rest, 2)]
        second += [F.lit(t), _masked(column, finer, 2 + t)]
    return _masked(column, first, 1), F.element_at(F.create_map(*second), F.col("t"))


def simhash_classes(docs: DataFrame, hot: int = 20_000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row: 3-word shingles, at most two differing bits.

    Exact: every pair within the radius is linked. Equal fingerprints are compared once, whatever their number. Null
    and empty texts have fingerprint zero and are linked like any other. A null doc_id takes its fingerprint's class
    but names none (its class is null if it holds only null ids). Repeated ids keep one row each.
    """
    rows = materialize(fingerprints(docs))
    found = materialize(rows.groupBy("f0").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("many")))
    edges = _links(_refined(found.where("id is not null"), 1, *block_keys("f0"), hot), 1, 2)
    classes = components(edges)
    named = found.join(classes, F.col("id") == F.col("node"), "left").select("f0", F.coalesce("component", "id").alias("component_id"), "many")
    out = join_counted(rows, materialize(named), "f0")
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def similar(pairs: DataFrame, docs: DataFrame, k: int, least: float) -> DataFrame:
    """Those of the pairs (a, b; a written table) of doc ids whose sets of k-word shingle hashes have a Jaccard similarity of
    ``least`` or more.

    Ids are first replaced by a digest of their set, so that copies are one: equal digests need no comparison, and each pair of
    different sets is compared once, however many documents have them. An id or a set in very many pairs is joined by
    broadcast (``join_counted``), so it fills no task. Sets, not texts, are compared; an id is one document, and of rows that
    repeat it the one of the smallest digest stands for it.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(0, b.num_rows, 500):
                part = b.slice(n, 500)
                found = [np.unique(np.concatenate([*shingle_hashes(t or b"", k), np.zeros(0, np.uint64)])) for t in part.column(1).cast(pa.binary()).to_pylist()]
                at = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                digests = pa.array([hashlib.sha256(f.tobytes()).digest()[:16] for f in found], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), digests, pa.ListArray.from_arrays(at, pa.array(np.concatenate(found).view(np.int64)))], ["id", "digest", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                whole = len(x) + len(y) - both
                same.append(both >= least * whole)
            yield b.select([0, 1]).filter(pa.array(same, pa.bool_()))

    def counted(rows: DataFrame, key: str, values: DataFrame, of: DataFrame) -> DataFrame:
        """``rows`` with ``values`` by key, the keys counted in ``of``; a plain join where no key has many rows."""
        if of.count() <= 10_000:
            return rows.join(values, key)
        many = of.groupBy(key).agg(F.count(F.lit(1)).alias("many"))
        total, most = many.agg(F.sum("many"), F.max("many")).first()
        if not total or most <= 10_000 or most * 1000 <= total:
            return rows.join(values, key)
        return join_counted(rows, materialize(values.join(many, key)), key)

    if pairs.isEmpty():
        return pairs.select("a", "b")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")
    found = materialize(texts.mapInArrow(sets, "id long, digest binary, hashes array<long>"))
    named = materialize(found.groupBy("id").agg(F.min("digest").alias("digest")))
    given = pairs
    for end in ("a", "b"):
        pairs = counted(pairs, end, named.select(F.col("id").alias(end), F.col("digest").alias(f"d{end}")), given)
    pairs = materialize(pairs)
    low, high = F.least("da", "db").alias("da"), F.greatest("da", "db").alias("db")
    tried = materialize(pairs.where("da <> db").select(low, high).distinct())
    held = found.join(named, ["id", "digest"], "left_semi").dropDuplicates(["digest"]).select("digest", "hashes")
    one = counted(tried, "da", held.select(F.col("digest").alias("da"), F.col("hashes").alias("x")), tried)
    two = counted(one, "db", held.select(F.col("digest").alias("db"), F.col("hashes").alias("y")), tried)
    near = materialize(two.select("da", "db", "x", "y").mapInArrow(compare, "da binary, db binary"))
    same = pairs.where("da = db").select("a", "b")
    other = pairs.where("da <> db").select("a", "b", low, high).join(near, ["da", "db"], "left_semi").select("a", "b")
    return same.unionByName(other)


def near_duplicates(docs: DataFrame, k: int = 5, radius: int = 72, hot: int = 20_000, least: float = 0.8, sure: int = 32) -> DataFrame:
    """(doc_id, component_id) of all documents; those linked by shingle similarities of ``least`` or more share a component.

    Candidates share one of eight keys of three shingle minima and differ in at most ``radius`` of the 256 bits of their
    fingerprints; a link is kept only where the k-word shingle sets themselves are similar enough. At a similarity of 0.8
    fingerprints differ in 39 bits (deviation 6), in 48 where the sets have four and five shingles, and a pair has no
    common key once in 300 times (0.9: once in 30,000), which is what is missed. Equal fingerprints are compared once.
    ``hot`` only bounds tasks: the rows of a key of more different fingerprints meet in pairs of blocks (all pairs still do).

    Pairs of ``sure`` bits or less are tried first, as many as it takes to connect them, and those that hold make classes.
    Then, twice, each document's nearest candidate of another class is tried, and at last all pairs of candidates that are
    still of different classes. Their number has no bound but the groups' sizes squared, if very many documents are a little
    less similar than ``least``.

    Null and empty texts are copies of each other. Rows of a null doc_id take no part. Rows that repeat an id are one
    document, one of whose texts is compared; extra columns play no part; an empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, k, 4, keys=True).where("id is not null"))
    whole = ["f0", "f1", "f2", "f3"]
    first = F.min(F.struct("id", "band")).alias("m"), F.count(F.lit(1)).alias("many")
    found = materialize(rows.groupBy(*whole).agg(*first).select(*whole, "m.*", "many"))
    pair = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    tried = materialize(_links(_in_blocks(found, 4, F.col("band"), hot), 4, sure, compared=True).select(*pair).distinct())
    held = materialize(similar(tried, docs, k, least))
    classes, moved = components(held), True
    for nearest in (True, True, False):
        if nearest and not moved:
            continue  # the same classes have the same nearest candidates
        classed = found.join(classes, F.col("id") == F.col("node"), "left").withColumn("kind", F.coalesce("component", "id"))
        others = _links(_in_blocks(classed, 4, F.col("band"), hot, "kind"), 4, radius, kind="kind", nearest=nearest).select(*pair).distinct()
        others = materialize(others.join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(others)
        more = materialize(similar(others, docs, k, least))
        moved = not more.isEmpty()
        if moved:
            held = held.unionByName(more)
            classes = components(held)
    named = found.join(classes, F.col("id") == F.col("node"), "left").select(*whole, F.coalesce("component", "id").alias("component_id"), "many")
    out = join_counted(rows.select("id", *whole), materialize(named), whole)
    return out.select(F.col("id").alias("doc_id"), "component_id")


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each class: that with the smallest doc_id. Rows of a null doc_id stay.

    Rows that repeat a kept id all stay: an id is one document.
    """
    gone = near_duplicates(docs, **how).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
