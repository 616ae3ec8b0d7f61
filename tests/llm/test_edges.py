"""All queries and stages on tables with nulls, repeated ids and rows, empty and very long texts and clashing columns, and on empty tables."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import lines, registry, secrets, simhash
from tests.llm.test_operators import base_spans, crc, groups, print_of

CLASH = ("id", "part", "src", "blob", "kind", "key", "row", "h", "f0", "band", "node", "component", "component_id", "many", "seed", "at", "to", "n", "start", "score", "y", "words", "shard", "slot", "__id", "__gone")
RNG = random.Random(21)
WORDS = ["".join(RNG.choices("abcdefghilmnorst", k=5)) for _ in range(4_000)]
LONG = "\n".join(" ".join(RNG.choices(WORDS, k=12)) for _ in range(6_000))  # 430,000 characters
SAME = "the same seven words stand here twice"
ROWS = [
    (None, SAME, "en", "a"), (None, None, None, None), (7, None, "en", "a"), (7, "", "en", "a"), (7, SAME, "en", "b"), (7, SAME, "en", "b"), (8, SAME + " or so", "en", None), (9, LONG, "en", "a"), (10, "e\n\n\n", "de", "b"),
    (11, "x", None, "a"), (12, LONG[:9_000], "en", "c"), (13, "password: hunter22hunter22", "en", "c"), (13, "token = abcdefgh12345678", "en", "c"), (14, "é" * 300 + " \U0001f642", "fr", "a"),
]
QUERIES = sorted(registry.queries())


def folder(spark, path, rows, vectors):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    clash = lambda df: df.withColumns({c: F.lit("clash") for c in CLASH})
    clash(docs).coalesce(2).write.parquet(f"{path}/documents.parquet")
    labels = [(7, 1, 0), (7, 0, 0), (8, 1, 0), (9, 0, 0), (None, 1, 0), (12, None, 1), (99, 1, 0), (13, 0, 0)] if rows else []
    clash(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).write.parquet(f"{path}/labels.parquet")
    bench = [(1, LONG[100:400]), (1, LONG[100:400]), (2, None), (None, SAME), (3, "words")] if rows else []
    clash(spark.createDataFrame(bench, "item_id long, text string")).write.parquet(f"{path}/benchmark.parquet")
    talk = [(1, 0, "user", None), (1, 1, "assistant", "yes"), (None, None, None, None), (2, 0, "user", LONG), (2, 0, "user", LONG)] if rows else []
    clash(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).write.parquet(f"{path}/conversations.parquet")
    clash(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=16).tolist(), 0) for i in range(90, 120)] + [(100, rng.normal(size=16).tolist(), 0), (105, [0.0] * 16, 0), (200, None, 0), (None, [1.0] * 16, 0), (300, [1.0] * 3, 0), (106, None, None)]
    return folder(spark, tmp_path_factory.mktemp("odd") / "t", ROWS, vectors)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("empty") / "t", [], [])


@pytest.mark.parametrize("name", QUERIES)
def test_query_on_empty_tables(spark, empty, name):
    out = registry.queries()[name](spark, empty)
    assert out.count() == (name == "op11_chat_format") and out.columns[0] in ("doc_id", "query_id", "conv_id", "lang", "word")  # op11 adds a conversation


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def run(spark, folder_, name):
    return registry.queries()[name](spark, folder_).collect()


def ids(rows):
    return collections.Counter(r["doc_id"] for r in rows)


IDS = collections.Counter(r[0] for r in ROWS)


def test_sharding(spark, odd):
    got = run(spark, odd, "op2_sharding")
    assert ids(got) == IDS
    assert collections.Counter((r["doc_id"], r["text_crc32"]) for r in got) == collections.Counter((i, zlib.crc32((t or "").encode())) for i, t, _, _ in ROWS)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(len({r["shard"] for r in got if r["doc_id"] == i}) == 1 for i in IDS)


def test_quality(spark, odd):
    got = run(spark, odd, "op3_quality_classifier")
    assert ids(got) == IDS and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_nearest(spark, odd):
    got = run(spark, odd, "op4_nearest")
    assert {r["query_id"] for r in got} == {100} and sorted(r["rank"] for r in got) == list(range(1, 11))
    assert all(r["vec_id"] not in (None, 100, 105, 106, 200, 300) or r["vec_id"] in (105, 106) for r in got)


def test_simhash(spark, odd):
    got = run(spark, odd, "op5_simhash")
    assert ids(got) == IDS
    want = collections.Counter((i, f"{print_of(t):016x}") for i, t, _, _ in ROWS)
    assert collections.Counter((r["doc_id"], r["fingerprint"]) for r in got) == want
    prints = sorted({print_of(t) for _, t, _, _ in ROWS})
    link = groups(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 2])
    least = {}
    for i, t, _, _ in ROWS:
        if i is not None:
            least[link[print_of(t)]] = min(i, least.get(link[print_of(t)], i))
    assert all(r["component_id"] == least[link[int(r["fingerprint"], 16)]] for r in got)


def test_decontamination(spark, odd):
    got = run(spark, odd, "op6_decontamination")
    assert collections.Counter((r["doc_id"], r["item_id"]) for r in got) == {(9, 1): 1, (12, 1): 1, (None, 3): 1, (7, 3): 2, (8, 3): 1}


def test_tokens(spark, odd):
    library = Tokenizer.from_file(registry.vocabulary())
    library.no_truncation()
    encoded = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t, _, _ in ROWS]
    got = run(spark, odd, "op7_bpe")
    want = collections.Counter((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in encoded)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got) == want
    got = run(spark, odd, "op9_token_files")
    want = collections.Counter((i, len(x) + 1, crc([*x, 2])) for i, x in encoded if i is not None)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted(i for i, _ in encoded if i is not None)


def test_lines(spark, odd):
    got = run(spark, odd, "op8_line_dedup")
    assert ids(got) == IDS
    kept = collections.defaultdict(set)
    for r in got:
        kept[r["doc_id"]].add((r["n_lines_removed"], r["kept_sha256"]))
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    for i in (None, 7, 8, 9, 10, 11, 13, 14):  # nothing of these was there before
        assert kept[i] == {(0, sha(t)) for j, t, _, _ in ROWS if j == i}
    # of the excerpt only the line that was cut in two is its own
    n = LONG[:9_000].count("\n")
    assert kept[12] == {(n, sha(LONG[:9_000].split("\n")[-1]))}


def test_lines_of_repeated_ids(spark):
    """A span of one row is not cut out of another row with the same id that reads otherwise there."""
    text, other = "one line of words\nanother line of words\n", "quite different text\nof two lines as long\n"
    df = spark.createDataFrame([(1, text + "a", "s"), (2, text + "b", "s"), (2, other + "c", "s"), (3, text + "b", "s"), (3, text + "b", "s")], "doc_id long, text string, source string")
    got = collections.Counter((r["doc_id"], r["text"]) for r in lines.dedup_runs(df).collect())
    assert got == {(1, text + "a"): 1, (2, text + "b"): 1, (2, other + "c"): 1, (3, "b"): 2}


def test_secrets(spark, odd):
    got = run(spark, odd, "op10_secret_scan")
    assert ids(got) == IDS
    want = collections.Counter((i, hashlib.sha256(",".join(x[2] for x in base_spans(t)).encode()).hexdigest()) for i, t, _, _ in ROWS)
    assert collections.Counter((r["doc_id"], r["base_sha256"]) for r in got) == want


def test_secret_limits(spark):
    """A value in up to two repositories of one owner is live; a third repository or a second owner makes it an example."""
    value = lambda c: "ghp_" + c * 30
    rows = [(1, value("a"), "s"), (2, value("a"), "s"), (3, value("b"), "s"), (4, value("b"), "s"), (5, value("b"), "s"), (6, value("c"), "s"), (7, value("c"), "t")]
    got = {r["doc_id"]: r["n_live"] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
    wide = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_repos=3, max_owners=2)
    assert {r["n_live"] for r in wide.collect()} == {1}


def test_secrets_of_a_text_full_of_them(spark):
    """Positions take linear time: 20,000 matches in one text."""
    text = "é ".join(f"{i:032x}" for i in range(20_000))
    row = secrets.scan_secrets(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    assert row["n_hex"] == 20_000 and row["spans"].endswith(f"hex:{34 * 19_999}:{34 * 19_999 + 32}")


def test_near_duplicates(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    got = simhash.near_duplicates(docs).collect()
    assert ids(got) == collections.Counter({i: n for i, n in IDS.items() if i is not None})
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and collections.Counter(r["doc_id"] for r in kept.collect()) == IDS


def test_stages(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, odd))
        assert out.columns == docs.columns and not ids(out.collect()) - ids(docs.collect())
        docs = out
    got = corpus_pipeline.STAGES[-1][1](spark, docs, odd).collect()
    assert ids(got) == ids(docs.collect())


def test_chat(spark, odd):
    got = {r["conv_id"]: r for r in run(spark, odd, "op11_chat_format")}
    assert set(got) == {1, 2, None, -7} and got[2]["n_turns"] == 2 and got[2]["loss_chars"] == 0 and got[1]["loss_chars"] == 3
    assert got[2]["turns_sha256"] == hashlib.sha256(f"user\n{LONG}\nuser\n{LONG}\n".encode()).hexdigest()


def test_divergence_and_variants(spark, odd):
    got = run(spark, odd, "op12_source_divergence")
    assert {(r["lang"], r["source"]) for r in got} == {("en", s) for s in ("", "a", "b", "c")} | {("", ""), ("", "a")} and all(r["value"] == 0 for r in got)
    assert run(spark, odd, "op13_spelling_variants") == []
