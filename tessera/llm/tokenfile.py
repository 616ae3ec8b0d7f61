"""Token ids in raw binary shards with a minimal perfect hash index.

A shard file holds, little-endian:

    magic | id width (2 or 4), documents n, distinct keys k, ids m, index levels l (u64 each) | words per level (u64 x l)
    levels' bits (u64) | set bits before every 8 words (u64) | by slot: fingerprint (u32 x k), first document (u32 x k)
    by document: key (i64 x n), start (u64 x n+1) | ids

The index is a cascade of bit arrays: a key is placed at the first level where its hash bit is its alone; its slot is the
number of set bits before it, so n keys get the slots 0..n-1. The fingerprint at the slot tells keys that were never
stored. A lookup reads the header, 64 bytes a level, one count, fingerprint, key and two offsets, and then the document's
own ids, whatever the file's size.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, partitions, shared_dir

MAGIC = b"TIDX0001"
ABSENT = -1
WORDS = 8


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys, built level by level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        words = np.concatenate([*levels, np.zeros(0, np.uint64)])
        ones = np.bitwise_count(words).astype(np.int64)
        self.words, self.before = words, np.cumsum(ones) - ones
        self.first = np.cumsum([0, *map(len, levels)])

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.7) -> PerfectHash:
        left, levels = keys.astype(np.int64).view(np.uint64), []
        while len(left):
            bits = max(64, -(-int(gamma * len(left)) // 64) * 64)
            at = (_mix(left, len(levels)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64).copy())
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys must be distinct")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; ABSENT where no level has a bit. A key that wasn't stored may get another key's slot."""
        k = keys.astype(np.int64).view(np.uint64)
        out = np.full(len(k), ABSENT, np.int64)
        open_ = np.arange(len(k))
        for n, level in enumerate(self.levels):
            at = (_mix(k[open_], n) % np.uint64(64 * len(level))).astype(np.int64)
            word, bit = at // 64, (at % 64).astype(np.uint64)
            hit = (level[word] >> bit & np.uint64(1)).astype(bool)
            w = self.first[n] + word[hit]
            below = np.bitwise_count(self.words[w] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[open_[hit]] = self.before[w] + below
            open_ = open_[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.astype(np.int64).view(np.uint64), 1 << 20) >> np.uint64(32)).astype("<u4")


class Shard:
    """A shard file's content. ``keys`` and ``start`` are in the order of the ids; equal keys follow each other."""

    def __init__(self, data: bytes):
        f = io.BytesIO(data)
        if f.read(8) != MAGIC:
            raise ValueError("not a token shard")
        read = lambda kind, n: np.frombuffer(f.read(n * np.dtype(kind).itemsize), kind)
        self.width, n, k, m, levels = read("<u8", 5).tolist()
        sizes = read("<u8", levels).tolist()
        self.index = PerfectHash([read("<u8", s) for s in sizes])
        read("<u8", -(-len(self.index.words) // WORDS))
        self.prints, self.first = read("<u4", k), read("<u4", k)
        self.keys, self.start = read("<i8", n), read("<u8", n + 1).astype(np.int64)
        self.ids = read("<u2" if self.width == 2 else "<u4", m)

    @staticmethod
    def pack(keys: np.ndarray, lengths: np.ndarray, payload: list[bytes], width: int) -> list[bytes]:
        """The file's parts. ``keys`` must be sorted."""
        distinct, first = np.unique(keys, return_index=True)
        index = PerfectHash.build(distinct)
        slot = index.slots(distinct)
        by_slot = np.empty((2, len(distinct)), "<u4")
        by_slot[:, slot] = fingerprint(distinct), first
        start = np.r_[0, np.cumsum(lengths)]
        head = np.array([width, len(keys), len(distinct), start[-1], len(index.levels), *map(len, index.levels)], "<u8")
        before = index.before[::WORDS].astype("<u8")
        return [MAGIC, head.tobytes(), *(x.astype("<u8").tobytes() for x in index.levels), before.tobytes(), by_slot.tobytes(), keys.astype("<i8").tobytes(), start.astype("<u8").tobytes(), *payload]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first document of each key; ABSENT for keys that aren't stored (but for one in 2^32)."""
        slot = self.index.slots(keys)
        there = slot >= 0
        there[there] = self.prints[slot[there]] == fingerprint(keys[there])
        out = np.full(len(keys), ABSENT, np.int64)
        out[there] = self.first[slot[there]]
        return out


# -- encoding with the tokenizers library

#: Latin letters, then perhaps a run of marks: one word, or two. (The dotted capital I isn't one letter in lower case.)
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([-.,;:!?$%&*#@+=/()]{0,4})").fullmatch


class Encoder:
    """The library's encoding, piece by piece: white space ends every token of this vocabulary, so the pieces between
    ASCII white space are encoded once each and remembered (a bounded number of them). Letters and the marks after them
    are words of their own and letter case doesn't count, so the library sees each word only once."""

    def __init__(self, path: str, keep: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        self.keep, self.young, self.old, self.marks = keep, {}, {}, {"": b""}
        # every word's last token, and no other, bears the word end's mark
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], step: int = 512) -> list[bytes]:
        """The ids of single words: many are encoded as one text, whose tokens the word ends part again."""
        out, w = [], self.width
        groups = [words[i: i + step] for i in range(0, len(words), step)]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(g):
                out += self._alone(g)
                continue
            raw, stop = ids.tobytes(), ((last + 1) * w).tolist()
            out += [raw[i:j] for i, j in zip([0, *stop], stop)]
        return out

    def _learn(self, texts: list[list[bytes]]) -> None:
        missing = set().union(*texts) - self.young.keys()
        if len(self.young) + len(missing) > self.keep:
            self.old, self.young = self.young, {}
            missing = set().union(*texts)
        if len(self.marks) > 20_000:
            self.marks = {"": b""}
        young, old = self.young, self.old
        parted, alone, words, marks = [], [], {}, set()
        for p in missing:
            ids = old.get(p)
            if ids is not None:
                young[p] = ids
                continue
            m = PLAIN(t := p.decode())
            if not m:
                alone.append((p, t))
                continue
            word, mark = m.groups()
            key = word.lower().encode()
            if key not in young:
                ids = old.get(key)
                if ids is None:
                    words[key] = word
                else:
                    young[key] = ids
            if mark not in self.marks:
                marks.add(mark)
            parted.append((p, key, mark))
        young.update(zip(words, self._words(list(words.values()))))
        self.marks.update(zip(marks, self._alone(list(marks))))
        known = self.marks
        for p, key, mark in parted:
            young[p] = young[key] + known[mark]
        young.update(zip((p for p, _ in alone), self._alone([t for _, t in alone])))

    def encode(self, texts: list[bytes], step: int = 4 << 20) -> Iterator[bytes]:
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= step):
                size += len(texts[j])
                j += 1
            pieces = [t.split() for t in texts[i:j]]
            self._learn(pieces)
            for p in pieces:
                yield b"".join(map(self.young.__getitem__, p))
            i = j


@lru_cache(2)
def _encoder(name: str) -> Encoder:
    return Encoder(SparkFiles.get(name))


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _save(folder: str, keys: np.ndarray, lengths: np.ndarray, payload: list[bytes], width: int) -> pa.RecordBatch:
    store, root = _open(folder)
    store.create_dir(root)
    target = f"{root}/shard-{uuid.uuid4().hex}.tid"
    with store.open_output_stream(f"{target}.part") as out:
        for part in Shard.pack(keys, lengths, payload, width):
            out.write(part)
    store.move(f"{target}.part", target)
    row = (target.rsplit("/", 1)[-1], int(keys[0]), int(keys[-1]), len(keys), int(lengths.sum()))
    return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["file", "least", "most", "docs", "ids"])


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2, shard_ids: int = 32_000_000) -> DataFrame:
    """Encodes and writes all documents in ascending doc_id order; returns the manifest, one row per shard file.

    Shards are ranges of doc_id, of ``shard_ids`` ids or one key more. A file gets its final name by a rename, once
    whole, and counts only if its task's row arrives in the manifest, so lost and repeated tasks leave no trace in it.
    Null and empty texts have only the end id. Rows of a null doc_id aren't written. Rows that repeat an id follow each
    other in the order of their texts; the index leads to the first.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]
    slim = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = slim.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(name)
        end = np.array([end_id], coder.kind).tobytes()
        keys, lengths, payload, many = [], [], [], 0
        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), coder.encode(b.column(1).cast(pa.binary()).to_pylist())):
                if many >= shard_ids and key != keys[-1]:
                    yield _save(folder, np.array(keys), np.array(lengths), payload, coder.width)
                    keys, lengths, payload, many = [], [], [], 0
                keys.append(key)
                payload += [ids, end]
                lengths.append(len(ids) // coder.width + 1)
                many += lengths[-1]
        if keys:
            yield _save(folder, np.array(keys), np.array(lengths), payload, coder.width)

    return dealt.mapInArrow(run, "file string, least long, most long, docs long, ids long")


def read_tokens(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shard files alone, found through the index."""
    # one row per shard file; a running sum over their few thousand rows
    placed = manifest.withColumn("start", F.sum("ids").over(W.orderBy("least").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("ids"))
    placed = placed.repartition(2 * partitions(spark), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
                shard = load(folder, file)
                # each key through the index, then on over the rows that repeat it
                at = shard.find(shard.keys)
                new = np.r_[True, shard.keys[1:] != shard.keys[:-1]]
                at += np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                start, end = shard.start[at], shard.start[at + 1]
                crc = [zlib.crc32(shard.ids[a:z].astype("<u4").tobytes()) for a, z in zip(start.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard.keys), pa.array(start + base), pa.array(end - start), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def load(folder: str, file: str) -> Shard:
    store, root = _open(folder)
    with store.open_input_file(f"{root}/{file}") as f:
        return Shard(f.read())


class TokenStore:
    """Keyed access to the shards of a manifest: a key's document is read by its place, never a whole file."""

    HEAD = 48 + 8 * 200  # the fixed numbers and the sizes of the most levels that a shard may have

    def __init__(self, folder: str, manifest: list):
        self.store, self.root = _open(folder)
        self.rows = sorted(manifest, key=lambda r: r["least"])
        self.least = [r["least"] for r in self.rows]
        self.bytes_read = 0

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the document with this key (of several, the first); None for a key that isn't stored."""
        i = bisect_right(self.least, key) - 1
        if i < 0 or key > self.rows[i]["most"]:
            return None
        with self.store.open_input_file(f"{self.root}/{self.rows[i]['file']}") as f:
            return self._find(f, key)

    def _read(self, f: pa.NativeFile, kind: str, at: int, n: int) -> np.ndarray:
        data = f.read_at(n * np.dtype(kind).itemsize, at)
        self.bytes_read += len(data)
        return np.frombuffer(data, kind)

    def _find(self, f: pa.NativeFile, key: int) -> np.ndarray | None:
        head = self._read(f, "u1", 0, self.HEAD).tobytes()
        if not head.startswith(MAGIC):
            raise ValueError("not a token shard")
        width, n, k, _, levels = np.frombuffer(head, "<u8", 5, 8).tolist()
        sizes = np.frombuffer(head, "<u8", levels, 48).tolist()
        words, bits = sum(sizes), 48 + 8 * levels
        counts = bits + 8 * words
        prints = counts + 8 * -(-words // WORDS)
        one, base = np.array([key], np.int64), 0
        for level, size in enumerate(sizes):
            place = int(_mix(one.view(np.uint64), level)[0] % np.uint64(64 * size))
            word, bit = base + place // 64, place % 64
            start = word // WORDS * WORDS
            block = self._read(f, "<u8", bits + 8 * start, min(WORDS, words - start))
            mine = int(block[word - start])
            if mine >> bit & 1:
                below = int(np.bitwise_count(block[: word - start]).sum()) + (mine & (1 << bit) - 1).bit_count()
                slot = int(self._read(f, "<u8", counts + 8 * (start // WORDS), 1)[0]) + below
                return self._payload(f, one, slot, prints, width, n, k)
            base += size
        return None

    def _payload(self, f: pa.NativeFile, one: np.ndarray, slot: int, prints: int, width: int, n: int, k: int) -> np.ndarray | None:
        if self._read(f, "<u4", prints + 4 * slot, 1)[0] != fingerprint(one)[0]:
            return None
        doc = int(self._read(f, "<u4", prints + 4 * (k + slot), 1)[0])
        keys = prints + 8 * k
        if self._read(f, "<i8", keys + 8 * doc, 1)[0] != one[0]:
            return None
        start, end = self._read(f, "<u8", keys + 8 * n + 8 * doc, 2).tolist()
        return self._read(f, "<u2" if width == 2 else "<u4", keys + 8 * n + 8 * (n + 1) + width * start, end - start)


def lookup(folder: str, manifest: list, key: int) -> np.ndarray | None:
    """One document's ids by its key: the shard by its range, the slot by the index. None for an unknown key."""
    return TokenStore(folder, manifest).get(key)


def tokenize_to_files(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Writes token files to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = materialize(write_tokens(docs, vocabulary, folder, end_id))
    return read_tokens(spark, manifest, folder)
