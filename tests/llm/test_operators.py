"""The training-data operators against brute force, and on nulls, empty texts, ties, repeated rows and empty tables."""

import collections
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import ann, bpe, components, decontaminate, lines, quality, registry, secrets, sharding, simhash, suffixes, tokenfile
from tests.conftest import DATA

ODD = [
    (900_001, None), (900_002, ""), (900_003, ""), (900_004, "x"), (900_005, "same words here again"), (900_006, "same words here again"),
    (900_007, "Ünïcode ß — straße! 's don't İ 東京   tab\tnl\r\n<|endoftext|> é"), (900_008, "y" * 70_000), (900_009, "ab " * 30_000),
]
SCHEMA = "doc_id long, text string, source string"


def texts(extra=True):
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text", "source"]).to_pylist()
    return [(r["doc_id"], r["text"], r["source"]) for r in t] + [(i, x, None) for i, x in ODD if extra]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(registry.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# -- 1


def repeats(rows, length):
    first, out = {}, {}
    for i, t in sorted(rows):
        for w in {t[j: j + length] for j in range(len(t) - length + 1)}:
            first.setdefault(w, i)
    for i, t in rows:
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if first[t[j: j + length]] < i:
                gone[j: j + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, docs):
    want = repeats([(i, (t or "").encode()) for i, t, _ in texts()], 50)
    got = by_id(suffixes.remove_repeats(docs, 50))
    assert {i: tuple(r)[1:5] for i, r in got.items()} == want


@pytest.mark.parametrize("hot", [1 << 14, 2])
def test_suffix_dedup_overlaps_and_copies(spark, hot):
    rng = random.Random(3)
    whole = "".join(rng.choice("abé") for _ in range(900))
    rows = []
    for i in range(60):
        a, b = sorted(rng.sample(range(900), 2))
        rows.append((i, whole[a:b] + rng.choice(["", "zz", "é"]) + whole[b // 2: b // 2 + rng.randrange(120)], None))
    got = by_id(suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA), 50, part_bytes=4_000, hot=hot))
    assert {i: tuple(r)[1:5] for i, r in got.items()} == repeats([(i, t.encode()) for i, t, _ in rows], 50)


def test_suffix_dedup_ids(spark, none):
    """Null ids, ids above 2^53 and repeated ids: the first copy always stays."""
    text, other = "the quick brown fox " * 6, "jumps over the lazy dog and on " * 4
    rows = [(2**60 + i, text, None) for i in range(1, 9)] + [(None, text, None), (5, other, None), (5, other, None), (5, other + text, None), (6, other, None), (7, None, None), (7, "", None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"part": F.lit("clash"), "src": F.lit(1), "blob": F.lit(2)})
    got = sorted(suffixes.remove_repeats(df, 50).collect(), key=lambda r: (r["doc_id"] or -1, r["n_bytes"]))
    gone = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in got}
    assert len(got) == len(rows)
    assert gone == {(2**60 + i, len(text)): len(text) for i in range(1, 9)} | {(None, len(text)): 0, (5, len(other)): 0, (5, len(other + text)): 0, (6, len(other)): len(other), (7, 0): 0}
    alone = suffixes.remove_repeats(df.where("doc_id > 100 OR doc_id IS NULL"), 50).collect()
    assert {(r["doc_id"], r["n_removed"]) for r in alone} == {(2**60 + i, len(text) if i > 1 else 0) for i in range(1, 9)} | {(None, 0)}
    assert suffixes.remove_repeats(none, 50).count() == 0


def test_suffix_dedup_memory():
    """What is left of a part's texts is found in a few times their bytes, however much of them goes."""
    rng = np.random.default_rng(5)
    half = [rng.integers(97, 123, 2_000, np.uint8).tobytes().decode() for _ in range(1_000)]
    docs = pa.table({"part": pa.array([0] * 2_000, pa.int32()), "doc_id": range(2_000), "text": half + half})
    message = suffixes._table(suffixes._answer_anchors(suffixes._table(suffixes._send_anchors(docs, 50, 20, 1)), 1 << 14))
    tracemalloc.start()
    sent = suffixes._send_contexts(docs, message, 50, 20, 1)
    asked = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    message = suffixes._table(suffixes._answer_contexts(suffixes._table(sent), 50, 20))
    tracemalloc.start()
    removed = suffixes._finish(docs, message, 50, False)[2].to_pylist()
    finished = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert removed == [0] * 1_000 + [2_000] * 1_000
    assert asked < 20 * 4e6 and finished < 6 * 4e6


def test_merge_sort_is_a_sort():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (300, 24)).astype(np.uint8)
    size, group = rng.integers(0, 25, 300), np.sort(rng.integers(0, 5, 300))
    x[np.arange(24) >= size[:, None]] = 0
    order, common = suffixes.merge_sort(x, size, group)
    rows = [(group[i], x[i, : size[i]].tobytes()) for i in order]
    assert rows == sorted(rows)
    for (g, a), (h, b), c in zip(rows, rows[1:], common[1:]):
        assert c == (len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a, b)))) if g == h else 0)


# -- 2


def test_sharding(spark, docs):
    doubled = docs.unionByName(docs.limit(20))
    got = sharding.shard_documents(doubled, 16).collect()
    assert len(got) == docs.count() + 20 and {r["law"] for r in got} == {"key"}
    for s in range(16):
        mine = sorted(r["slot"] for r in got if r["shard"] == s)
        assert mine == list(range(len(mine)))
    want = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in texts()}
    of = collections.defaultdict(set)
    for r in got:
        assert (r["size"], r["text_crc32"]) == want[r["doc_id"]]
        assert r["grown_shard"] in (r["shard"], 16)
        of[r["doc_id"]].add(r["shard"])
    assert all(len(x) == 1 for x in of.values())
    assert {r["doc_id"]: r["grown_shard"] for r in got} == {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 17).collect()}


def test_shard_weights(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"))
    n = collections.Counter(r["shard"] for r in sharding.assign_shards(rows, "id", [1.0, 0.0, 3.0]).collect())
    assert set(n) == {0, 2} and 0.72 < n[2] / 20_000 < 0.78


# -- 3


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return (np.sum(pos[:, None] > neg) + 0.5 * np.sum(pos[:, None] == neg)) / (len(pos) * len(neg))


def test_quality_on_held_out(spark):
    folder = DATA.replace("0.001", "0.01")
    got = {r["doc_id"]: r for r in registry.op3_quality_classifier(spark, folder).collect()}
    labels = pq.read_table(f"{folder}/labels.parquet").to_pylist()
    held = [(r["quality"], got[r["doc_id"]]["score"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"] in got]
    y, s = np.array(held).T
    assert auc(y, s) > 0.85
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)


def test_trees_and_statistics(spark, docs, none):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit(x, y)
    assert auc(y, model.score(x)) > 0.95

    def one(row):
        raw = model.base
        for f, c, leaf in zip(model.feature, model.cut, model.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > c[at])
            raw += leaf[at - len(f)]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose([one(r) for r in x[:50]], model.score(x[:50]))
    data = [(t or "").encode() for _, t, _ in texts()]
    off = np.cumsum([0, *map(len, data)])
    every = quality.statistics(np.frombuffer(b"".join(data), np.uint8), off)
    each = np.vstack([quality.statistics(np.frombuffer(d, np.uint8), np.array([0, len(d)])) for d in data])
    assert np.allclose(every, each)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score_documents(docs, quality.train(docs, labels.where("false"))).collect()} == {0.5}
    assert quality.filter_quality(none, labels).count() == 0


# -- 4


@pytest.mark.parametrize("eps, batch", [(2.5, 16 << 20), (None, 1_500)])
def test_nearest(spark, eps, batch):
    path = f"{DATA.replace('0.001', '0.01')}/embeddings.parquet"
    t = pq.read_table(path, columns=["vec_id", "embedding"]).to_pylist()
    extra = [(10**6, None), (10**6 + 100, [0.0] * len(t[0]["embedding"])), (10**6 + 200, [float("nan")] * len(t[0]["embedding"])), (10**6 + 300, t[3]["embedding"]), (10**6 + 301, t[3]["embedding"])]
    rows = [(r["vec_id"], r["embedding"]) for r in t] + extra
    kind = spark.read.parquet(path).schema["embedding"].dataType.simpleString()
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").withColumns({"code": F.lit("clash"), "id": F.lit(1)})
    got = collections.defaultdict(list)
    for r in ann.nearest(df, eps=eps, batch_bytes=batch).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ok = [(i, np.array(v, float)) for i, v in rows if v and np.isfinite(v).all() and np.any(v)]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        assert [r for r, _, _ in got[q]] == list(range(1, len(best) + 1))
        for _, v, s in got[q]:
            assert abs(s - d[ids == v][0]) < 1e-12
        hits += len({v for _, v, _ in got[q]} & set(ids[best].tolist()))
        total += len(best)
    assert set(got) == set(ids[ids % 100 == 0].tolist()) and hits >= (0.98 if eps else 1) * total
    assert ann.nearest(df.where("vec_id = 1000000")).count() == 0


# -- 5


def print_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i: i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(ids, linked):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("hot", [20_000, 1])
def test_simhash_classes(spark, docs, hot):
    f = {i: print_of(t) for i, t, _ in texts()}
    want = groups(f, [(a, b) for a, b in itertools.combinations(f, 2) if (f[a] ^ f[b]).bit_count() <= 2])
    got = by_id(simhash.simhash_classes(docs, hot=hot))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{f[i]:016x}", want[i]) for i in f}


def test_bit_sliced_links():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (12, 4), np.uint64)
    f = base[rng.integers(0, 12, 500)] ^ (np.uint64(1) << rng.integers(0, 64, (500, 4)).astype(np.uint64)) * (rng.random((500, 4)) < 0.5).astype(np.uint64)
    key = np.sort(rng.integers(0, 9, 500))
    for radius in (0, 2, 3, 48):
        far = np.bitwise_count(f[:, None] ^ f[None]).sum(2)
        want = groups(range(500), [(i, j) for i, j in zip(*np.nonzero((far <= radius) & (key[:, None] == key))) if i < j])
        assert groups(range(500), simhash.link(key, f, radius).tolist()) == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = groups({x for e in real for x in e}, real)
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in got} == set(want.items())


@pytest.mark.parametrize("hot", [20_000, 3])
def test_near_duplicates(spark, hot):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows, origin = [], {}
    for g in range(30):
        base = [word() for _ in range(rng.choice([40, 200, 700]))]
        for c in range(1 + g % 5):
            mine = base[:]
            if c:
                for p in rng.sample(range(len(base)), len(base) // 60):
                    mine[p] = word()
            origin[100 * g + c] = 100 * g
            rows.append((100 * g + c, " ".join(mine), f"s{c}"))
    rows += [(90_000, None, None), (90_001, "", None), (None, "lonely", None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit(7)).withColumn("f0", F.lit("x"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, hot=hot).collect()}
    assert got == origin | {90_000: 90_000, 90_001: 90_000}
    kept = simhash.drop_near_duplicates(df, hot=hot)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {*origin.values(), 90_000, None}


@pytest.mark.parametrize("hot", [20_000, 3])
def test_near_duplicates_by_similarity(spark, hot):
    """Pairs of 0.6 to 1.0, against all pairs' exact similarity: none below 0.8 is linked, none above is lost."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for g in range(120):
        base = [word() for _ in range(rng.choice([9, 60, 120, 300]))]
        mine, at = base[:], rng.randrange(len(base))
        for p in range(at, min(len(base), at + g % 20 * len(base) // 100)):  # one passage anew
            mine[p] = word()
        rows += [(2 * g, " ".join(base), None), (2 * g + 1, " ".join(mine), None)]
    rows += [(1000, rows[4][1], None)]
    sets = {i: {tuple(w[j: j + 5]) for w in [t.split()] for j in range(len(w) - 4)} for i, t, _ in rows}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2)}
    assert sum(0.6 < x < 0.8 for x in like.values()) > 15 and sum(0.8 <= x < 0.9 for x in like.values()) > 15
    want = groups(sets, [p for p, x in like.items() if x >= 0.8])
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, hot=hot).collect()} == want


# -- 6


def test_masks_hit_every_pair_of_substitutions():
    for gone in itertools.combinations(range(decontaminate.WINDOW), decontaminate.WINDOW - decontaminate.LEAST):
        assert any(not {s + p for p in m} & set(gone) for m in decontaminate.MASKS for s in range(decontaminate.WINDOW - m[-1]))


def overlaps(a, b):
    """Whether some 13 aligned tokens have 11 equal ones (shorter items: occur whole)."""
    w = min(len(b), decontaminate.WINDOW)
    need = w if len(b) < decontaminate.WINDOW else decontaminate.LEAST
    for shift in range(w - len(b), len(a) - w + 1):
        same = [0 <= shift + j < len(a) and a[shift + j] == b[j] for j in range(len(b))]
        total = list(itertools.accumulate(same, initial=0))
        if any(total[j + w] - total[j] >= need for j in range(len(b) - w + 1)):
            return True
    return False


def test_decontamination(spark, none):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    items = [[word() for _ in range(n)] for n in (30, 14, 13, 12, 5, 60)]
    rows = []
    for i in range(80):
        d = [word() for _ in range(rng.randrange(60))]
        if i % 2:
            b = rng.choice(items)
            a = rng.randrange(len(b))
            part = b[a: a + rng.randrange(8, 30)]
            for p in rng.sample(range(len(part)), min(len(part), rng.randrange(4))):
                part = [*part[:p], word(), *part[p + 1:]]
            d[len(d) // 2: len(d) // 2] = part
        rows.append((i, d))
    df = spark.createDataFrame([(i, ", ".join(d).upper(), None) for i, d in rows] + [(900, None, None), (901, "", None)], SCHEMA).withColumn("item_id", F.lit("z"))
    bench = spark.createDataFrame([(k, " ".join(b)) for k, b in enumerate(items)] + [(50, None), (51, ""), (None, "ax ay az")], "item_id long, text string")
    want = {(i, k) for i, d in rows for k, b in enumerate(items) if overlaps(d, b)}
    assert 10 < len(want)
    for how in ({}, {"filter_bits": 1 << 12, "small": 0}):
        found = decontaminate.find_overlaps(df, bench, **how).collect()
        assert len(found) == len({(r["doc_id"], r["item_id"]) for r in found})
        assert {(r["doc_id"], r["item_id"]) for r in found} == want
        kept = decontaminate.drop_contaminated(df, bench, **how)
        assert kept.columns == df.columns
        # items of fewer than 8 tokens are reported, but no document goes for them
        assert {r["doc_id"] for r in kept.collect()} == {*range(80), 900, 901} - {i for i, k in want if len(items[k]) >= 8}
    assert decontaminate.find_overlaps(none, bench).count() == 0
    assert decontaminate.find_overlaps(df, bench.where("false")).count() == 0


def test_decontamination_rows(spark, docs):
    """Repeated ids, null ids, a very long text and short items; the best alignment against all alignments."""
    rng = random.Random(18)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    item = [word() for _ in range(20)]
    long = [word() for _ in range(60_000)]
    rows = [(1, " ".join(item), None), (1, "nothing of it", None), (1, " ".join(item), None), (None, "x " + " ".join(item[3:17]), None), (2, " ".join([*long, *item, *long[:9]]), None), (3, "the the", None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit(1), "seed": F.lit("clash")})
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, "the")], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.find_overlaps(df, bench).collect() if r["doc_id"])
    assert got == [(1, 7, 0, 20, 20, 1.0)] * 2 + [(2, 7, 60_000, 20, 20, 1.0), (3, 8, 0, 1, 1, 1.0)]
    assert [tuple(r) for r in decontaminate.find_overlaps(df, bench).where("doc_id IS NULL").collect()] == [(None, 7, 1, 14, 14, 1.0)]
    assert sorted(r["text"] for r in decontaminate.drop_contaminated(df, bench).collect()) == ["nothing of it", "the the"]


# -- 7


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_bpe(spark, docs, none, library):
    got = by_id(bpe.encode_documents(docs, registry.vocabulary(), with_ids=True))
    for i, t, _ in texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(none, registry.vocabulary()).count() == 0


def test_transducer_and_decoder(library):
    with open(registry.vocabulary(), encoding="utf-8") as f:
        v = bpe.Vocabulary(f.read(), keep=50)
    rng = random.Random(9)
    for n in (1, 5, 300, 3000):
        word = "".join(rng.choice("aeinorst") for _ in range(n))
        symbols = [*word[:-1], word[-1] + bpe.END]
        want = library.encode(word, add_special_tokens=False).tokens
        assert list(v.transduce(iter(symbols), block=16)) == want == v.merge(symbols)
    for t in ("it's We'LL x'd 12a b3 !!! ...a", "Σίσυφος ΣΑΣ Σ", "a<|endoftext|>b <|startoftext|", "ﬁne é   ​ \x1c x\x85y", "🙂🙂 नमस्ते ١٢٣"):
        ids = np.frombuffer(v.encode(t.encode()), "<u4").tolist()
        assert ids == library.encode(t, add_special_tokens=False).ids
        d = bpe.Decoder(v)
        assert "".join(d.feed(np.array([i])) for i in ids) + d.finish() == library.decode(ids, skip_special_tokens=False)
    # byte to text: characters that tokens cut in two are completed by later ids
    d, text = bpe.Decoder(v, raw=True), "ünïcode ß 東京 🙂 नमस्ते xyz"
    ids = np.frombuffer(v.encode(text.encode()), "<u4")
    pieces = [d.feed(ids[i: i + 1]) for i in range(len(ids))]
    assert "".join(pieces).split() == [w.strip() for w in v.words.findall(text)] and "" in pieces and d.finish() == ""
    assert d.feed(ids[:1]) and bpe.Decoder(v, raw=True).feed(np.zeros(0, np.int64)) == ""


def test_stream_in_blocks(library):
    with open(registry.vocabulary(), encoding="utf-8") as f:
        v = bpe.Vocabulary(f.read())
    text = "it's a tést of blocks, 12ab " * 40 + "q" * 500
    want = library.encode(text, add_special_tokens=False).ids
    parts = list(v.stream(text.encode(), block=50))
    assert len(parts) > 10 and np.frombuffer(b"".join(parts), "<u4").tolist() == want


def test_stream_without_white_space(library):
    """Texts without white space go through in blocks too, cut where a word ends in any surroundings."""
    with open(registry.vocabulary(), encoding="utf-8") as f:
        v = bpe.Vocabulary(f.read())
    rng = random.Random(4)
    odd = [*"aZ'sé0123456789<|>。、！，？漢字東京かがなカ", "\u3099", "e\u0301", "Σ", "ß", "<|endoftext|>", "<|startoftext|>", "'re", "ﬁ", "👍"]
    for block in (1, 3, 17, 50):
        text = "".join(rng.choice(odd) for _ in range(3_000))
        parts = list(v.stream(text.encode(), block))
        assert len(parts) > 20 and np.frombuffer(b"".join(parts), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    text = "".join(rng.choice(["abc1", "東京へ行く。", "x", "2024", "-"]) for _ in range(400_000))
    parts = list(v.stream(text.encode()))
    assert len(text.encode()) > 2 << 20 and len(parts) > 1 and np.frombuffer(b"".join(parts), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


# -- 8


def test_line_dedup(spark, none):
    rng = random.Random(10)
    common = ["\n".join(f"shared {g} line {k} ü" for k in range(14)) for g in range(3)]
    rows = [(i, "\n".join(x for _ in range(4) for x in ([f"own {rng.random()}"] * rng.randrange(3) + [rng.choice(common)] * (rng.random() < 0.4))), None) for i in range(40)]
    rows += [(100, None, None), (101, "", None), (102, common[0], None), (103, "one line", None), (104, "one line", None), (105, "\n\n\n\n", None), (None, common[1], None)]
    first, want = {}, {}
    for i, t, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        ls, gone = (t or "").encode().split(b"\n"), []
        for a, z in lines.chunk_lines(ls) if t and "\n" in t else []:
            part = b"\n".join(ls[a:z])
            if z - a > 1 and part.strip():
                if part in first:
                    gone += range(a, z)
                first.setdefault(part, i)
        want[i] = (len(gone), b"\n".join(x for k, x in enumerate(ls) if k not in set(gone)).decode() if t is not None else None)
    assert sum(n for n, _ in want.values()) > 100
    df = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.lit(1)).withColumn("__id", F.lit(2))
    out = lines.dedup_lines(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {i: t for i, (_, t) in want.items()} | {None: common[1]}
    assert {r["doc_id"]: r["n_lines_removed"] for r in lines.dedup_lines(df.where("doc_id is not null"), report=True).collect()} == {i: n for i, (n, _) in want.items()}
    assert lines.dedup_lines(none).count() == 0


def test_line_runs(spark, none):
    """Planted passages of 2 to 8 lines, one-line paragraphs and parts of paragraphs, against all windows of lines or sentences."""
    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))
    passages = ["\n".join(say(rng.randrange(8, 30)) for _ in range(n)) for n in range(2, 9)]
    sentences = [". ".join(say(9) for _ in range(7)) + "." for _ in range(4)]  # 63 words
    rows = []
    for i in range(60):
        parts = [say(rng.randrange(3, 20)) for _ in range(rng.randrange(1, 5))] + rng.sample(passages, 1 + i % 2)
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts), None))
    for i in range(60, 90):  # no line break: a paragraph with a passage in its middle, or a passage alone
        rows.append((i, f"{say(12)}. {rng.choice(sentences)} {say(12)}." if i % 3 else rng.choice(sentences), None))
    rows += [(100, None, None), (101, "", None), (102, passages[0], None), (103, "one line", None), (104, "one line", None), (105, "\n\n\n\n", None), (106, "one line\n", None), (None, passages[1], None)]
    seen, want = set(), {}
    for i, t, _ in [r for r in rows if r[0] is not None]:
        flat = []  # (text, whole line, number of its line)
        for k, x in enumerate((t or "").split("\n")):
            flat += [(y, False, k) for y in re.split(r"(?<=\.) ", x)] if len(x.split()) > 50 else [(x, True, k)]
        gone = set()
        for a in range(len(flat)):
            for z in range(a + 1, len(flat) + 1):
                w = flat[a:z]
                if sum(len(x.split()) for x, _, _ in w) > 50 or sum(whole and bool(x.split()) for x, whole, _ in w) > 1:
                    part = tuple((x, k - w[0][2]) for x, _, k in w)
                    gone |= set(range(a, z)) if part in seen else set()
                    seen.add(part)
        left: dict[int, list[str]] = {}
        for k, (x, _, n) in enumerate(flat):
            if k not in gone:
                left.setdefault(n, []).append(x)
        want[i] = t and "\n".join(" ".join(x) for x in left.values()), len({flat[k][2] for k in gone})
    assert all(any(want[i][1] == n for i in range(60)) for n in range(2, 9)) and sum(n for _, n in want.values()) > 300
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("at", F.lit(1)).withColumn("__id", F.lit(2))
    out = lines.dedup_runs(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: t for i, (t, _) in want.items()} | {None: passages[1]}
    assert {r["doc_id"]: r["n_lines_removed"] for r in lines.dedup_runs(df.where("doc_id is not null"), report=True).collect()} == {i: n for i, (_, n) in want.items()}
    assert lines.dedup_runs(none).count() == 0


def test_line_runs_of_copies(spark):
    """A near copy and an exact copy stay whole; a passage that another text has in common is cut, from the copy as well."""
    rng = random.Random(15)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))
    passage = "\n".join(say(15) for _ in range(4))
    own = [say(14) for _ in range(40)]
    near = [*own[:20], say(14), *own[21:]]
    whole, copy = "\n".join([*own[:5], passage, *own[5:]]), "\n".join([*near[:5], passage, *near[5:]])
    rows = [(1, passage + "\n" + say(30), None), (2, whole, None), (3, copy, None), (4, whole, None), (5, say(40) + "\n" + "\n".join(own[8:12]), None)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_runs(spark.createDataFrame(rows, SCHEMA), copies=0.8).collect()}
    assert got == {1: rows[0][1], 2: "\n".join(own), 3: "\n".join(near), 4: "\n".join(own), 5: rows[4][1].split("\n")[0]}


# -- 9


def test_token_files(spark, docs, library):
    got = by_id(tokenfile.tokenize_to_files(docs, registry.vocabulary()))
    at = 0
    for i, t, _ in sorted(texts()):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(got[i])[1:] == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(got) == len(texts())


def test_token_file_lookup(spark, docs, none, tmp_path, library):
    folder = str(tmp_path / "shards")
    twice = docs.unionByName(docs.where("doc_id = 900004"))
    manifest = tokenfile.write_tokens(twice, registry.vocabulary(), folder, shard_ids=5_000).collect()
    assert len(manifest) > 4 and sum(r["docs"] for r in manifest) == len(texts()) + 1
    for i, t, _ in texts()[::9]:
        assert tokenfile.lookup(folder, manifest, i).tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 2]
    assert tokenfile.lookup(folder, manifest, 777_777) is None and tokenfile.lookup(folder, [], 1) is None
    store = tokenfile.TokenStore(folder, manifest)
    before = store.bytes_read
    n = store.get(900_004).nbytes
    assert store.bytes_read - before < 3_000 + n  # the header and some words, whatever the shard's size
    assert tokenfile.tokenize_to_files(none, registry.vocabulary()).count() == 0


def test_perfect_hash_is_read_in_place(tmp_path):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(-(2**62), 2**62, 20_000))
    lengths = rng.integers(1, 9, len(keys))
    ids = np.arange(lengths.sum()).astype("<u4")
    data = b"".join(tokenfile.Shard.pack(keys, lengths, [ids.tobytes()], 4))
    (tmp_path / "a.tid").write_bytes(data)
    store = tokenfile.TokenStore(str(tmp_path), [{"file": "a.tid", "least": int(keys[0]), "most": int(keys[-1])}])
    ends = np.cumsum(lengths)
    for i in rng.integers(0, len(keys), 200):
        store.bytes_read = 0
        assert store.get(int(keys[i])).tolist() == ids[ends[i] - lengths[i]: ends[i]].tolist()
        assert store.bytes_read < 6_000 < len(data) / 50
    assert all(store.get(int(k) + 1) is None for k in keys[:200] if k + 1 not in keys)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5_000))
    assert sorted(tokenfile.PerfectHash.build(keys).slots(keys).tolist()) == list(range(len(keys)))
    assert len(tokenfile.PerfectHash.build(keys[:0]).slots(keys)) == len(keys)


# -- 10


def base_spans(t):
    t, out = t or "", []
    for k, (kind, pattern, group, least) in enumerate((
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", "(AKIA[A-Z0-9]+)", 1, 16), ("hex", "([0-9a-f]+)", 1, 32),
    )):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}", kind, m[group]) for m in re.finditer(pattern, t) if len(m[group]) >= least]
    return sorted(out)


def test_secret_scan(spark, docs, none):
    key, free = "0123456789abcdef" * 2, "ghp_" + "Ab1" * 10
    more = [
        (1_000_001, f"é🙂 Token = '{key}' AKIA{'Z' * 12} api_key:short API-KEY=x", "a"), (1_000_002, f"{free} {key}", "a"), (1_000_003, free, "b"),
        (1_000_004, "sk-" + "q" * 30, "c"), (1_000_005, f"password=abc secret: {'p' * 8}x{key}", None),
    ]
    df = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame(more, SCHEMA)).withColumn("h", F.lit("clash"))
    got = by_id(secrets.scan_secrets(df))
    for i, t, _ in texts() + more:
        found, r = base_spans(t), got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[3] == k for x in found) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(",".join(x[2] for x in found).encode()).hexdigest()
        assert set(filter(None, r["spans"].split(","))) >= {x[2] for x in found}
    # the token of one owner is live, that of two owners an example
    assert "token:0" in got[1_000_004]["spans"] and "token" not in got[1_000_003]["spans"] + got[1_000_002]["spans"]
    assert got[1_000_004]["n_live"] == 1 and got[1_000_003]["n_copied"] == 1
    assert secrets.scan_secrets(none).count() == 0
