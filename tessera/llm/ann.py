"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

Vectors are centred, normalised and rotated; the code keeps the signs. With o the rotated unit vector and c = sign(o) /
sqrt(d), <o, q> is estimated by <c, q> / <o, c>, and lies within eps * sqrt((1 - <o,c>^2) / <o,c>^2 / (d - 1)) of it with
high probability (with eps = sqrt(d - 1) always). <c, q> is counted on packed bits: the rotated query is rounded to 8 bits a
component, and each of its 8 bit planes is met with the code by AND and population count; what rounding can change is added
to the bounds. Only vectors whose lower bound doesn't exceed the k-th smallest distance known so far are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

PLANES = 8


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    out = np.zeros((len(bits), -(-packed.shape[1] // 8) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, norm of the centred vector, and <o, c>."""
    y = x - centre
    norm = np.sqrt((y * y).sum(1))
    o = (y @ turn.T) / np.maximum(norm, 1e-300)[:, None]
    return pack_bits(o > 0), norm, np.abs(o).sum(1) / np.sqrt(x.shape[1])


class Queries:
    """A bounded batch of queries, rotated and rounded to bit planes, with upper bounds of their k-th distances."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, eps: float, bound: np.ndarray):
        self.ids, self.vectors, self.k, self.eps, self.bound = ids, vectors, k, eps, bound
        turned = (vectors - centre) @ turn.T
        self.norm = np.sqrt((turned * turned).sum(1))
        self.low = turned.min(1)
        self.step = np.maximum(turned.max(1) - self.low, 1e-300) / (2**PLANES - 1)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = np.stack([pack_bits(level >> j & 1) for j in range(PLANES)], axis=1)
        self.total = self.low * vectors.shape[1] + self.step * level.sum(1, dtype=np.float64)

    def search(self, blocks: Iterator[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, vec_id, distance) of the k nearest of all blocks' rows for each query, within its bound."""
        n, k = len(self.ids), self.k
        best, names, many = np.full((n, k), np.inf), np.zeros((n, k), np.int64), np.zeros(n, np.int64)
        cut = self.bound.copy()
        for ids, vectors, codes, norms, cors in blocks:
            d = vectors.shape[1]
            safe = np.maximum(cors, 1e-9)
            spread = self.eps * np.sqrt(np.maximum(1 - safe**2, 0) / safe**2 / max(d - 1, 1))
            ones = np.bitwise_count(codes).sum(1, dtype=np.float64)
            scale = 2 * norms / (safe * np.sqrt(d))
            square = norms**2
            for i in range(n):
                count = np.zeros(len(ids), np.int64)
                for j in range(PLANES):
                    count += np.bitwise_count(codes & self.planes[i, j]).sum(1, dtype=np.int64) << j
                # <s, q> for the signs s = 2 * bits - 1
                signed = 2 * (self.low[i] * ones + self.step[i] * count) - self.total[i]
                low = square + self.norm[i] ** 2 - scale * (signed + d * self.step[i] / 2) - 2 * norms * spread * self.norm[i]
                low -= 1e-6 * (square + self.norm[i] ** 2)
                left = np.flatnonzero((low <= cut[i] ** 2) & (ids != self.ids[i]))
                if not len(left):
                    continue
                dist = np.sqrt(((vectors[left] - self.vectors[i]) ** 2).sum(1))
                near = dist <= cut[i]
                left, dist = left[near], dist[near]
                m = many[i]
                all_d, all_i = np.r_[best[i, :m], dist], np.r_[names[i, :m], ids[left]]
                first = np.lexsort((all_i, all_d))[:k]
                many[i] = len(first)
                best[i, : len(first)], names[i, : len(first)] = all_d[first], all_i[first]
                if len(first) == k:
                    cut[i] = min(cut[i], best[i, k - 1])
        some = np.arange(k) < many[:, None]
        return np.nonzero(some)[0], names[some], best[some]


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10, eps: float | None = 2.5, sample: int = 10_000, batch_bytes: int = 16 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of every row whose vec_id is divisible by ``every``.

    All rows are coded and stay where they are; queries go to them in broadcast batches of ``batch_bytes`` of vectors, one
    pass over the codes each, so that no vector is ever shuffled and no task holds more than a batch and a block of rows.
    The centre is the mean of at most ``sample`` rows (those of the smallest id hashes), among which each query also gets
    an upper bound of its k-th distance; both affect only how much is compared. ``eps`` None makes the bounds certain and
    the result exact. Ties go to the smaller vec_id.

    Vectors that are null, empty, all zero, of another length than most, or hold null or non-finite numbers take no
    part, nor do rows of a null vec_id. Rows that repeat an id are compared each; as queries they are one, with the k best
    rows of any of its vectors; a query never finds its own id. Extra columns play no part; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    ok = (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), "embedding").where(ok)
    dims = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    dim = dims["d"]
    rows = rows.where(F.size("embedding") == dim)
    # ``sample`` vectors at most
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    known, around = some["id"].to_numpy(), some["embedding"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim)
    centre, turn = around.mean(0), rotation(dim)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code, norm, cor = encode(vectors(b.column(1)), centre, turn)
                packed = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed, pa.array(norm), pa.array(cor)], ["id", "embedding", "code", "norm", "cor"])

    def vectors(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().astype(np.float64).reshape(-1, dim)

    kind = embeddings.schema["embedding"].dataType.simpleString()
    index = materialize(rows.mapInArrow(coded, f"id long, embedding {kind}, code binary, norm double, cor double"))
    asked = materialize(index.where(F.col("id") % every == 0).select("id", "embedding").distinct())
    batches = -(-asked.count() * dim * 8 // batch_bytes)
    best = None
    for n in range(batches):
        mine = asked.where(F.pmod(F.xxhash64("id", "embedding"), F.lit(batches)) == n).toArrow()  # about ``batch_bytes``
        if not mine.num_rows:
            continue
        ids, q = mine["id"].to_numpy(), vectors(mine["embedding"].combine_chunks())
        shared = spark.sparkContext.broadcast(Queries(ids, q, centre, turn, k, np.sqrt(dim - 1) if eps is None else eps, _bounds(ids, q, known, around, k)))

        def search(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            blocks = (
                (b.column(0).to_numpy(), vectors(b.column(1)), np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(b.num_rows, -1), b.column(3).to_numpy(), b.column(4).to_numpy())
                for b in parts if b.num_rows
            )
            which, found, dist = shared.value.search(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.ids[which]), pa.array(found), pa.array(dist)], ["query_id", "vec_id", "score"])

        part = index.mapInArrow(search, "query_id long, vec_id long, score double")
        best = part if best is None else best.unionByName(part)
    if best is None:
        return spark.createDataFrame([], schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _bounds(ids: np.ndarray, q: np.ndarray, known: np.ndarray, around: np.ndarray, k: int, step: int = 1024) -> np.ndarray:
    """For each query, the k-th smallest distance among the sample, a little enlarged for rounding; infinite if it has fewer rows."""
    out = np.full(len(ids), np.inf)
    square = (around**2).sum(1)
    for a in range(0, len(ids), step):
        far = square + (q[a: a + step] ** 2).sum(1)[:, None] - 2 * (q[a: a + step] @ around.T)
        far[known == ids[a: a + step, None]] = np.inf
        if far.shape[1] >= k:
            slack = 1e-9 * (square.max() + (q[a: a + step] ** 2).sum(1))
            out[a: a + step] = np.sqrt(np.maximum(np.partition(far, k - 1, axis=1)[:, k - 1], 0) + slack)
    return out
