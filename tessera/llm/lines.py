"""Line dedup by runs of lines and sentences, or by content-defined chunks of lines.

The queries remove runs (``dedup_runs``): whatever two texts have in common over two lines with content, or over more
than 50 words, is found whole, wherever it lies. A line of more than 50 words counts by its sentences.

Chunks (``dedup_lines``) are sparser: one ends after a line when the rolling hash over the last few line hashes meets a
fixed condition, so inserted or removed lines move only the boundaries near them. Chunks of at least two lines that
occur more than once in the corpus are removed everywhere but at their first occurrence.

Both compare bytes with the first occurrence's before anything is removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, fresh, join_counted, materialize
from .simhash import fingerprints, similar

M64 = (1 << 64) - 1


def chunk_lines(lines: list[bytes], average: int = 4, window: int = 2, longest: int = 64) -> list[tuple[int, int]]:
    """Chunks as (first line, line after the last). A chunk ends where the hash of the last ``window`` line hashes is 0
    modulo ``average``, and after ``longest`` lines at the latest."""
    hashes = [xxhash.xxh64_intdigest(x.strip(), 1) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        rolled = 0
        for h in hashes[max(0, i - window + 1): i + 1]:
            rolled = (rolled * 0x9E3779B97F4A7C15 + h) & M64
        rolled ^= rolled >> 29
        if rolled % average == 0 or i - start + 1 >= longest:
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def chunks(docs: DataFrame, average: int, window: int, longest: int) -> DataFrame:
    """(id, no, at, to, lines, h0, h1): byte spans and 128-bit hashes of all chunks of two lines or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, no, at, to, many, h0, h1 = ([] for _ in range(7))
            for r, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                if not text or b"\n" not in text:
                    continue
                lines = text.split(b"\n")
                start = [0]
                for x in lines:
                    start.append(start[-1] + len(x) + 1)
                for k, (i, j) in enumerate(chunk_lines(lines, average, window, longest)):
                    part = text[start[i]: start[j] - 1]
                    if j - i < 2 or not part.strip():
                        continue
                    d = hashlib.blake2b(part, digest_size=16).digest()
                    row.append(r)
                    no.append(k)
                    at.append(start[i])
                    to.append(start[j] - 1)
                    many.append(j - i)
                    h0.append(int.from_bytes(d[:8], "little", signed=True))
                    h1.append(int.from_bytes(d[8:], "little", signed=True))
            ids = b.column(0).take(pa.array(row, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int32()) for x in (no, at, to, many)), pa.array(h0, pa.int64()), pa.array(h1, pa.int64())], ["id", "no", "at", "to", "lines", "h0", "h1"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(run, f"id {kind}, no int, at int, to int, lines int, h0 long, h1 long")


def repeated_chunks(docs: DataFrame, average: int = 4, window: int = 2, longest: int = 64) -> DataFrame:
    """(doc_id, no, at, to, lines, first_id, first_no) of every chunk occurrence to remove.

    An occurrence is kept where it comes first by (doc_id, chunk number). Others are removed if their bytes equal the
    first one's; on a hash collision they stay. Rows of a null doc_id take no part. Rows that repeat an id lose a chunk
    only where all of them hold its bytes.
    """
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    found = materialize(chunks(texts, average, window, longest))
    # partial sums first: a chunk in a third of all documents becomes one row per task
    first = found.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("id", "no", "at", "to")).alias("first")).where("many > 1")
    hits = materialize(join_counted(found, materialize(first), ["h0", "h1"]))
    mine = F.struct("id", "no", "at", "to")
    others = hits.where(~mine.eqNullSafe(F.col("first"))).select("id", "at", "to", F.col("first.id").alias("first_id"), F.col("first.at").alias("first_at"), "no", "lines", F.col("first.no").alias("first_no"))
    return _verified(texts, others).select(F.col("id").alias("doc_id"), "no", "at", "to", "lines", "first_id", "first_no")


def _verified(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Those of ``spans`` (id, at, to, first_id, first_at, ..; a written table) whose bytes are those at the first place.

    Only texts with spans or first places are shuffled. What is compared is each different string once: a span in a third
    of all documents becomes one row a task before it meets its first place. Strings that differ after all (their hashes
    collided) are then taken out.
    """
    size = (F.col("to") - F.col("at")).alias("size")
    key = ["first_id", "first_at", "size"]
    none = F.lit(None)
    keepers = spans.select(F.col("first_id").alias("id"), F.col("first_at").alias("at"), (F.col("first_at") + size).cast("int").alias("to")).distinct()
    keepers = keepers.select("*", none.cast(spans.schema["id"].dataType).alias("first_id"), none.cast("int").alias("first_at"))
    wanted = spans.select("id", "at", "to", "first_id", "first_at").distinct().unionByName(keepers)
    wanted = wanted.groupBy("id").agg(F.collect_list(F.struct("at", "to", "first_id", "first_at")).alias("wanted"))
    ids = materialize(spans.select("id").unionByName(spans.select(F.col("first_id").alias("id"))).distinct())
    cut = F.expr("transform(wanted, x -> named_struct('x', x, 'bytes', substring(cast(text as binary), x.at + 1, x.to - x.at)))")
    some = among(texts, "doc_id", ids)
    sliced = some.join(wanted, some["doc_id"] == wanted["id"]).select("id", F.explode(cut).alias("s")).select("id", "s.x.*", F.col("s.bytes").alias("bytes"))
    strings = sliced.where("first_id IS NOT NULL").select("id", "at", *key[:2], size, "bytes")
    kinds = strings.groupBy(*key, "bytes").agg(F.count(F.lit(1)).alias("n"))
    kept = sliced.where("first_id IS NULL").select(F.col("id").alias("first_id"), F.col("at").alias("first_at"), size, "bytes")
    # of a first id that several rows repeat, all must agree
    kept = kept.groupBy(*key).agg(F.min("bytes").alias("kept"), F.max("bytes").alias("too"))
    unlike = materialize(kinds.join(kept, key, "left").where("kept IS NULL OR kept <> too OR bytes <> kept").select(*key, "bytes"))
    if unlike.isEmpty():
        return spans
    wrong = strings.join(unlike, [*key, "bytes"], "left_semi").select("id", "at", *key)
    return spans.withColumn("size", F.col("to") - F.col("at")).join(wrong, ["id", "at", *key], "left_anti").drop("size")


def _touched(docs: DataFrame, per: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with the columns of ``per`` (one row an id, in column ``key``) where it has one, and the other rows."""
    per = materialize(per)
    ids = per.select(key)
    some = among(docs, "doc_id", ids)
    return some.join(per, some["doc_id"] == per[key]).drop(key), among(docs, "doc_id", ids, "left_anti")


def _cut(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    """The text without the spans; a removed chunk takes the line break after it, or else the one before it, along."""
    out, at = [], 0
    for a, z in sorted(gone):
        out.append(text[at:a])
        at = min(z + 1, len(text))
    out.append(text[at:])
    whole = b"".join(out)
    return whole[:-1] if gone and max(z for _, z in gone) >= len(text) and whole.endswith(b"\n") else whole


def dedup_lines(docs: DataFrame, average: int = 4, window: int = 2, longest: int = 64, keep_all_columns: bool = True, report: bool = False) -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text``; with ``report``, doc_id, n_lines_removed, n_chunks_removed, kept_text.

    Rows without repeated chunks, with null or empty text or a null doc_id come out unchanged; a text may become empty.
    """
    gone = repeated_chunks(docs, average, window, longest)
    key, spans = fresh(docs, "__id"), fresh(docs, "__gone")
    per = gone.groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(F.collect_list(F.struct("at", "to", "lines"))).alias(spans))
    joined, rest = _touched(docs, per, key)
    joined = joined.unionByName(rest.withColumn(spans, F.lit(None).cast(joined.schema[spans].dataType)))
    # what lies between the removed spans, in bytes: from each one's end to the next one's start
    starts = f"transform({spans}, x -> x.at)"
    cut = F.expr(
        f"""case when {spans} is null then text else
        cast(array_join(transform(zip_with(concat(array(0), transform({spans}, x -> x.to + 1)), concat({starts}, array(octet_length(text))),
          (a, z) -> hex(substring(cast(text as binary), a + 1, greatest(z - a, 0)))), x -> x), '') as string) end"""
    )
    last = F.element_at(F.col(spans), -1)["to"] >= F.octet_length("text")
    whole = F.decode(F.unhex(cut), "UTF-8")
    # without a last line, the break before it goes too
    cut = F.when(F.col(spans).isNull(), F.col("text")).when(last & F.endswith(whole, F.lit("\n")), F.substring(whole, 1, F.length(whole) - 1)).otherwise(whole)
    if report:
        total = F.coalesce(F.aggregate(spans, F.lit(0), lambda a, x: a + x["lines"]), F.lit(0)).cast("long")
        n = F.coalesce(F.size(F.col(spans)), F.lit(0))
        return joined.select("doc_id", total.alias("n_lines_removed"), F.when(n > 0, n).otherwise(0).cast("long").alias("n_chunks_removed"), cut.alias("kept_text"))
    return joined.select(*[cut.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


# -- runs

#: After a sentence: white space, or nothing after a full-width mark.
_STOP = re.compile(rb"(?<=[.!?])[ \t]+|(?<=\xe3\x80\x82)|(?<=\xef\xbc\x81)|(?<=\xef\xbc\x9f)")
_SPACE = b" \t\r"


def units(text: bytes, long: int = 50) -> list[tuple[int, int, int, int]]:
    """(at, to, words, lines) of the lines of a text, or of the sentences of those of more than ``long`` words.

    ``lines`` is 1 for a whole line with content, else 0.
    """
    out, at = [], 0
    for line in text.split(b"\n"):
        to, words = at + len(line), len(line.split())
        if words <= long:
            out.append((at, to, words, 1 if words else 0))
        else:
            a = 0
            for m in _STOP.finditer(line):
                if m.start() > a:
                    out.append((at + a, at + m.start(), len(line[a: m.start()].split()), 0))
                a = m.end()
            if a < len(line):
                whole = 1 if a == 0 else 0
                out.append((at + a, to, len(line[a:].split()), whole))
        at = to + 1
    return out


def run_windows(text: bytes, long: int = 50) -> list[tuple[int, int]]:
    """Byte spans of the shortest windows of units, from each start on and up to each end, that count as a run: two
    lines with content or more than ``long`` words.

    Every run of units that counts is a union of such windows: the shortest from its start, the shortest to its end,
    and what lies between them is in one from an inner start or to an inner end.
    """
    u = units(text, long)
    out, j, words, lines = set(), 0, 0, 0
    for i in range(len(u)):
        while j < len(u) and words <= long and lines < 2:
            words += u[j][2]
            lines += u[j][3]
            j += 1
        if words <= long and lines < 2:
            break
        out.add((u[i][0], u[j - 1][1]))
        words -= u[i][2]
        lines -= u[i][3]
    i, words, lines = 0, 0, 0
    for j in range(len(u)):
        words += u[j][2]
        lines += u[j][3]
        while words - u[i][2] > long or lines - u[i][3] >= 2:
            words -= u[i][2]
            lines -= u[i][3]
            i += 1
        if words > long or lines >= 2:
            out.add((u[i][0], u[j][1]))
    return sorted(out)


def _hashed_windows(docs: DataFrame, long: int) -> DataFrame:
    """(h, id, at, to) of the run windows of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                row, h, at, to = [], [], [], []
                for r, text in enumerate(part.column(1).cast(pa.binary()).to_pylist()):
                    if not text:
                        continue
                    whole = memoryview(text)
                    found = run_windows(text, long)
                    row += [r] * len(found)
                    h += [xxhash.xxh3_64_intdigest(whole[a:z]) for a, z in found]
                    at += [a for a, _ in found]
                    to += [z for _, z in found]
                ids = part.column(0).take(pa.array(row, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64)), ids, pa.array(at, pa.int32()), pa.array(to, pa.int32())], ["h", "id", "at", "to"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(run, f"h long, id {kind}, at int, to int")


def fewest(spans: list[tuple[int, int]]) -> list[int]:
    """Places of the fewest of the spans, sorted by start, that cover all that they cover together."""
    out, end, i = [], -1, 0
    while i < len(spans):
        if spans[i][1] <= end:
            i += 1
            continue
        # of those that start no later than what is covered so far ends (or, after a gap, than this one), the longest
        start, best = max(end, spans[i][0]), i
        while i < len(spans) and spans[i][0] <= start:
            if spans[i][1] > spans[best][1]:
                best = i
            i += 1
        out.append(best)
        end = spans[best][1]
    return out


def _joined_windows(per: DataFrame) -> DataFrame:
    """(id, at, to, first_id, first_at): windows of a text that overlap and have the same first text, at the same
    distance, as one span; of these, the fewest that cover the same bytes. ``per``: id and, in ``all``, the windows
    (at, to, first_at, first_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, source, at, to, back = [], [], [], [], []
            lists = b.column(1)
            flat, off = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            a_, z_, f_ = (flat.field(k).to_pylist() for k in range(3))
            names = flat.field(3).to_pylist()
            for r in range(b.num_rows):
                last: dict = {}
                spans: list[list[int]] = []
                for k in sorted(range(off[r], off[r + 1]), key=lambda k: (a_[k], -z_[k])):
                    key = names[k], a_[k] - f_[k]
                    i = last.get(key)
                    if i is not None and a_[k] <= spans[i][1]:
                        spans[i][1] = max(spans[i][1], z_[k])
                        continue
                    last[key] = len(spans)
                    spans.append([a_[k], z_[k], k])
                for i in fewest([(a, z) for a, z, _ in spans]):
                    a, z, k = spans[i]
                    row.append(r)
                    source.append(k)
                    at.append(a)
                    to.append(z)
                    back.append(f_[k])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), pa.array(to, pa.int32()), flat.field(3).take(pa.array(source, pa.int64())), pa.array(back, pa.int32())],
                ["id", "at", "to", "first_id", "first_at"],
            )

    kind = per.schema["id"].dataType.simpleString()
    return per.mapInArrow(run, f"id {kind}, at int, to int, first_id {kind}, first_at int")


def _copies(texts: DataFrame, pairs: DataFrame, least: float, radius: int = 72, k: int = 5) -> DataFrame:
    """Those of ``pairs`` (id, first_id, a written table) whose sets of k-word shingles have a similarity of ``least`` or more:
    what the near-duplicate stage takes for copies, by the same test. Fingerprints that differ in more than ``radius`` of 256
    bits, as those of sets of 0.8 never do (39 bits, deviation 6), spare the comparison."""
    ids = materialize(pairs.select("id").unionByName(pairs.select(F.col("first_id").alias("id"))).distinct())
    bits = ["f0", "f1", "f2", "f3"]
    prints = fingerprints(among(texts, "doc_id", ids), k, 4).groupBy("id").agg(F.min(F.struct(*bits)).alias("mine"))
    prints = materialize(prints)
    counts = pairs.groupBy(F.col("first_id").alias("id")).agg(F.count(F.lit(1)).alias("many"))
    theirs = materialize(prints.join(counts, "id").select(F.col("id").alias("first_id"), F.col("mine").alias("theirs"), "many"))
    both = join_counted(pairs.join(prints, "id"), theirs, "first_id")
    far = sum((F.bit_count(F.col(f"mine.{f}").bitwiseXOR(F.col(f"theirs.{f}"))) for f in bits), F.lit(0))
    close = materialize(both.where(far <= radius).select(F.col("id").alias("a"), F.col("first_id").alias("b")))
    return similar(close, texts, k, least).select(F.col("a").alias("id"), F.col("b").alias("first_id"))


def repeated_runs(docs: DataFrame, long: int = 50, copies: float | None = None) -> DataFrame:
    """(doc_id, at, to, first_id, first_at) of what occurred before, by (doc_id, position): byte spans, which may overlap.

    With ``copies``, what a text repeats of a text to which it is at least so similar (the Jaccard similarity of five-word
    shingles) isn't counted: it is a copy of the whole, not a passage.

    Spans stay where their bytes differ from the first ones (a hash collision). A line or sentence is never removed at its
    first occurrence in the corpus. Rows of a null doc_id take no part; rows that repeat an id lose a span only where all of
    them hold its bytes. Null and empty texts and empty tables have no spans.
    """
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    found = materialize(_hashed_windows(texts, long))
    # partial counts and minima first: a window in a third of all documents becomes one row per task; what is counted is
    # the hash alone, as few windows occur twice
    counts = found.groupBy("h").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    hits = materialize(join_counted(found, materialize(counts), "h"))
    first = hits.groupBy("h").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("many"))
    later = join_counted(hits, materialize(first), "h").where(~F.struct("id", "at").eqNullSafe(F.col("first")))
    window = F.struct("at", "to", F.col("first.at").alias("first_at"), F.col("first.id").alias("first_id"))
    if copies is None:
        per = later.groupBy("id").agg(F.collect_list(window).alias("all"))
    else:
        # a row for each text and earlier text, however many windows they share
        shared = materialize(later.groupBy("id", F.col("first.id").alias("first_id")).agg(F.collect_list(window).alias("all")))
        pairs = materialize(shared.select("id", "first_id").where("id <> first_id"))
        whole = _copies(texts, pairs, copies)
        per = shared.join(whole, ["id", "first_id"], "left_anti").groupBy("id").agg(F.flatten(F.collect_list("all")).alias("all"))
    spans = materialize(_joined_windows(per))
    return _verified(texts, spans).select(F.col("id").alias("doc_id"), "at", "to", "first_id", "first_at")


def cut_runs(text: bytes, gone: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The text without the spans, the number of lines cut whole or in part, and that of separate spans.

    Whole lines take the line break after them along, or else the one before; sentences the white space beside them.
    """
    runs: list[list[int]] = []
    for a, z in sorted(gone):
        if runs and (a <= runs[-1][1] or not text[runs[-1][1]: a].strip()):
            runs[-1][1] = max(runs[-1][1], z)
        else:
            runs.append([a, z])
    out, at, lines, line = bytearray(), 0, 0, -1
    for a, z in runs:
        # the number of the line in which the span starts, counted on from the last one
        top, bottom = text.count(b"\n", 0, a), text.count(b"\n", 0, z)
        lines += bottom - top + (top != line)
        line = bottom
        out += text[at:a]
        at = z
        ends = z == len(text) or text[z: z + 1] == b"\n"
        if a == 0 or text[a - 1: a] == b"\n":
            if ends and z < len(text):
                at = z + 1
            elif ends and out.endswith(b"\n"):
                del out[-1:]
        elif ends:
            out = bytearray(out.rstrip(_SPACE))
        while not ends and text[at: at + 1] in (b" ", b"\t"):
            at += 1
    out += text[at:]
    return bytes(out), lines, len(runs)


def dedup_runs(docs: DataFrame, long: int = 50, report: bool = False, copies: float | None = None) -> DataFrame:
    """``docs`` with repeated runs cut out of ``text``; with ``report``, doc_id, n_lines_removed (whole or in part),
    n_chunks_removed (separate spans), kept_text.

    Rows without repeated runs, with null or empty text or a null doc_id come out unchanged; a text may become empty. ``copies``
    leaves copies of whole texts alone, as in ``repeated_runs``.
    """

    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(text.cast(pa.binary()).to_pylist(), spans.to_pylist()):
            kept, lines, n = cut_runs(t, [(x["at"], x["to"]) for x in s]) if s else (t, 0, 0)
            out.append({"text": kept.decode("utf-8", "replace") if s else kept, "lines": lines, "n": n})
        return pa.array(out, pa.struct([("text", pa.string()), ("lines", pa.int64()), ("n", pa.int64())]))

    key, spans, done = fresh(docs, "__id"), fresh(docs, "__gone"), fresh(docs, "__cut")
    per = repeated_runs(docs, long, copies).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("at", "to")).alias(spans))
    joined, rest = _touched(docs, per, key)
    joined = joined.withColumn(done, F.arrow_udf(cut, "text string, lines long, n long")("text", spans))
    if report:
        zero = F.lit(0).cast("long")
        joined = joined.select("doc_id", F.col(f"{done}.lines").alias("n_lines_removed"), F.col(f"{done}.n").alias("n_chunks_removed"), F.col(f"{done}.text").alias("kept_text"))
        return joined.unionByName(rest.select("doc_id", zero.alias("n_lines_removed"), zero.alias("n_chunks_removed"), F.col("text").alias("kept_text")))
    return joined.select(*[F.col(f"{done}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]).unionByName(rest)
