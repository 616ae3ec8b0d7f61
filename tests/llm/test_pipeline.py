"""The corpus pipeline, stage by stage, on the smallest tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tessera.llm import lines, registry
from tests.conftest import DATA


def test_registered():
    found = __spark_entry__.queries()
    assert "pipeline" in found and set(registry.queries()) <= set(found)
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


def test_stages(spark):
    folder = DATA.replace("0.001", "0.01")  # the smallest tables have too few labels for the classifier to reject any
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder))
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before) and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name != "lines":
            assert all(before[i] == r for i, r in after.items()) and len(after) < len(before)
        before = after
    got = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()}
    assert set(got) == set(before)
    assert all(hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() == r["ids_sha256"] for r in got.values())


@pytest.mark.parametrize("rows", ["none", "odd"])
def test_stages_on_odd_tables(spark, rows):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0 if rows == "none" else 3)
    docs = docs.withColumns({"text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "component_id": F.lit(1), "id": F.lit(2), "score": F.lit(3.0)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        out.collect()


def test_what_is_left_between_lines_and_near_duplicates(spark):
    """Texts a little less similar than copies lose the lines that they repeat; copies are left to the next stage, which drops them."""
    rng = np.random.default_rng(8)
    words = ["".join(w) for w in rng.choice(list("abcdefghilmnorst"), size=(5_000, 5))]

    def text(n):
        return [" ".join(rng.choice(words, 15)) for _ in range(n)]

    rows, far = [], []
    for i in range(20):
        one = text(60)
        gap = text(10)  # 150 of 900 words: a similarity of about 0.7
        far += [2 * i + 1]
        rows += [(2 * i, "\n".join(one)), (2 * i + 1, "\n".join(one[:25] + gap + one[35:]))]
    for i in range(10):
        one = text(60)
        rows += [(100 + 2 * i, "\n".join(one)), (101 + 2 * i, "\n".join([*one[:-1], " ".join(one[-1].split()[:-3])]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    cut = corpus_pipeline.materialize(corpus_pipeline.cut_repeated_lines(spark, docs, DATA))
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    before = dict(rows)
    assert all(len(left[i].split()) < 160 for i in far) and all(left[i] == before[i] for i in left if i not in far)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, cut, DATA).collect()}
    assert kept == set(range(40)) | {100 + 2 * i for i in range(10)}


def test_line_stage_compares_texts_by_spans(spark, monkeypatch):
    """A passage of many lines that texts share is one row where copies of whole texts are told from passages."""
    passage = "\n".join(f"line {i} of a passage that many texts share" for i in range(60))
    own = lambda d: "\n".join(f"text {d} has a line {i} of its own, number {d * 1000 + i}" for i in range(40))
    docs = spark.createDataFrame([(d, f"{passage}\n{own(d)}") for d in range(20)], "doc_id long, text string")
    most, materialize = [], lines.materialize

    def seen(df):
        out = materialize(df)
        if {"first", "first_id"} & set(df.columns):
            most.append(out.count())
        return out

    monkeypatch.setattr(lines, "materialize", seen)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_runs(docs, copies=0.8).collect()}
    assert got == {d: f"{passage}\n{own(0)}" if d == 0 else own(d) for d in range(20)}
    assert max(most) < 100
