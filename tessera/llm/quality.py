"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed where the documents lie (Arrow batches, byte-level numpy). The model is fitted on a bounded,
hash-ordered sample of labelled rows and flattened into arrays, so that scoring a batch is a handful of vectorised
gathers per tree level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, spans, utf8

BLOCK = 4 << 20

FEATURES = (
    "bytes", "words", "lines", "word_len", "upper", "digit", "space", "non_ascii", "stop", "comma", "exclaim", "bar",
    "mark", "bracket", "other_punct", "distinct_words", "distinct_lines", "short_lines", "run", "byte_entropy", "caps_words", "sentence_len",
)


def _class_counts(buf: np.ndarray, start: np.ndarray, end: np.ndarray, member: np.ndarray) -> np.ndarray:
    total = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(member, out=total[1:], dtype=np.int32)
    return (total[end] - total[start]).astype(np.float64)


def _lut(chars: str | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) if isinstance(c, str) else c for c in chars]] = True
    return out


LUTS = {
    "upper": _lut(range(65, 91)), "digit": _lut(range(48, 58)), "space": _lut(" \t\n\r\v\f"), "non_ascii": _lut(range(192, 256)), "stop": _lut(".?"),
    "comma": _lut(",;:"), "exclaim": _lut("!"), "bar": _lut("|"), "mark": _lut("#$%&*@^~+=_<>\\"), "bracket": _lut("()[]{}\"'"), "newline": _lut("\n"),
    "other_punct": _lut("-/`"),
}


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per document over its whole text. Empty texts give zeros."""
    n = len(offsets) - 1
    start, end = offsets[:-1], offsets[1:]
    size = (end - start).astype(np.float64)
    c = {k: _class_counts(buf, start, end, lut[buf]) for k, lut in LUTS.items()}
    one = np.maximum(size, 1)
    same = np.zeros(len(buf), bool)
    if len(buf) > 1:
        same[1:] = buf[1:] == buf[:-1]
    run = _class_counts(buf, start, end, same)
    distinct_words, words, distinct_lines, lines, short, caps = (np.zeros(n) for _ in range(6))
    entropy = np.zeros(n)
    data = buf.tobytes()
    for i in range(n):
        text = data[start[i]: end[i]]
        if not text:
            continue
        w = text.split()
        ls = text.split(b"\n")
        words[i], distinct_words[i] = len(w), len(set(w))
        lines[i], distinct_lines[i] = len(ls), len(set(ls))
        short[i] = sum(len(x) < 40 for x in ls)
        caps[i] = c["upper"][i] and sum(map(bytes.isupper, w))
        p = np.bincount(buf[start[i]: end[i]], minlength=256)
        p = p[p > 0] / len(text)
        entropy[i] = -(p * np.log2(p)).sum()
    many, rows = np.maximum(words, 1), np.maximum(lines, 1)
    out = {k: c[k] / one for k in ("upper", "digit", "space", "non_ascii", "stop", "comma", "exclaim", "bar", "mark", "bracket", "other_punct")}
    out |= {
        "bytes": size, "words": words, "lines": lines, "word_len": (size - c["space"]) / many, "distinct_words": distinct_words / many,
        "distinct_lines": distinct_lines / rows, "short_lines": short / rows, "run": run / one, "byte_entropy": entropy, "caps_words": caps / many,
        "sentence_len": words / (c["stop"] + 1),
    }
    return np.column_stack([out[k] for k in FEATURES]) if n else np.zeros((0, len(FEATURES)))


def _statistics_of(column: pa.Array) -> np.ndarray:
    buf, offsets = utf8(column)
    parts = [statistics(buf[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]) for i, j in spans(offsets, BLOCK)]
    return np.vstack(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Trees:
    """Complete trees of one depth, flattened: ``feature`` and ``cut`` in heap order, ``leaf`` left to right."""

    depth: int
    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            raw += leaf[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 4.0) -> Trees:
    """Histogram boosting with logistic loss. One class or no rows: a constant score (0.5 with no rows)."""
    inner, leaves = 2**depth - 1, 2**depth
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    base = float(np.log(share / (1 - share)))
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if not len(y) or y.min() == y.max():
        return Trees(depth, base, feature[:0], cut[:0], leaf[:0])
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.column_stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)])  # bin b: at most cuts[b]
    raw = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)  # node within the level
        for level in range(depth):
            nodes = 2**level
            first = nodes - 1
            best = np.full(nodes, 1e-9)
            for j in range(d):
                k = at * bins + binned[:, j]
                gl = np.bincount(k, g, nodes * bins).reshape(nodes, bins).cumsum(1)
                hl = np.bincount(k, h, nodes * bins).reshape(nodes, bins).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gr, hr = gt - gl, ht - hl
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gt**2 / (ht + l2)
                gain[(hl < least) | (hr < least)] = -1
                gain = gain[:, : len(cuts[j])]
                if not gain.shape[1]:
                    continue
                b = gain.argmax(1)
                top = gain[np.arange(nodes), b]
                better = top > best
                best[better] = top[better]
                feature[t, first: first + nodes][better] = j
                cut[t, first: first + nodes][better] = cuts[j][b[better]]
            f, c = feature[t, first: first + nodes][at], cut[t, first: first + nodes][at]
            at = 2 * at + (x[np.arange(n), f] > c)
        leaf[t] = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        raw += leaf[t][at]
    return Trees(depth, base, feature, cut, leaf)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, held_out_fifth: int | None = 0, label: str = "quality") -> Trees:
    """Fits on at most ``max_rows`` labelled documents, those with the smallest hashes of their ids.

    Rows whose crc32(doc_id as text) mod 5 is ``held_out_fifth`` are never learnt from (None: all are used). Null ids
    or labels and labels without a document take no part; of several labels of one id the smallest counts, of several
    documents of one id the one with the smallest statistics. The sample, and only it, reaches the driver: at most
    max_rows x len(FEATURES) numbers, however often ids repeat.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if held_out_fifth is not None:
        usable = usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != held_out_fifth)
    chosen = usable.groupBy("doc_id").agg(F.min(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # max_rows pairs of numbers: bounded by the parameter
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _statistics_of(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *(pa.array(x[:, j]) for j in range(len(FEATURES)))], ["doc_id", "y", *FEATURES])

    schema = f"{rows.select('doc_id').schema.simpleString()[7:-1]}, y int, " + ", ".join(f"{f} double" for f in FEATURES)
    one = rows.mapInArrow(measure, schema).groupBy("doc_id").agg(F.min(F.struct("y", *FEATURES)).alias("m"))
    sample = one.select("doc_id", "m.*").toPandas().sort_values("doc_id")
    return fit(sample[list(FEATURES)].to_numpy(float), sample["y"].to_numpy(float))


def score_documents(docs: DataFrame, model: Trees, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score (0 to 1, higher: better) and predicted (1 from ``threshold`` on) of every row; map-only.

    Null and empty texts are scored as texts without any words. Rows, repeated or not, each get a score.
    """
    slim = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            s = model.score(_statistics_of(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    head = slim.select(*keep).schema
    return slim.mapInArrow(run, head.add("score", "double").add("predicted", "integer"))


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns as they were; map-only after training."""
    model = train(docs, labels, max_rows, held_out_fifth=None)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            s = model.score(_statistics_of(b.column(at)))
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
