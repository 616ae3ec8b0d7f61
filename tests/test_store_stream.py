"""Versions stored from a stream: any split into batches, repeated batches, late and repeated commits."""

import itertools

import pytest

from tessera.streaming import live

COMMITS = [  # (source, commit, committed, recorded, content by element)
    ("s", "c1", 10, 100, {1: "a", 2: "b", 3: "c"}),
    ("s", "c3", 30, 101, {1: "a", 2: "B", 4: "d"}),
    ("t", "c1", 15, 102, {1: "x"}),
    ("s", "c2", 20, 103, {1: "A", 2: "b"}),  # late: before c3
    ("s", "c1", 10, 104, {1: "a", 2: "b", 3: "c"}),  # again
    ("s", "c3", 30, 105, {1: "other"}),  # again with another content
    ("s", "c4", 40, 106, {2: "B"}),
]


def rows(some):
    return [(s, c, at, r, "k", e, x) for s, c, at, r, held in some for e, x in held.items()]


def expected():
    """Each commit in turn over plain tuples (source, element, content, from, to, recorded, superseded)."""
    out, known = [], {}
    for s, c, at, r, held in COMMITS:
        if (s, c) in known:
            continue
        later = min((a for (x, _), a in known.items() if x == s and a > at), default=None)
        now = {o[1]: o for o in out if o[0] == s and o[6] is None and o[3] <= at and (o[4] is None or o[4] > at)}
        for e in now.keys() | held.keys():
            old = now.get(e)
            if old and old[2] == held.get(e):
                continue
            if old:
                out[out.index(old)] = (*old[:6], r)
                if old[3] < at:
                    out.append((s, e, old[2], old[3], at, r, None))
                if later is not None and (old[4] is None or old[4] > later):
                    out.append((s, e, old[2], later, old[4], r, None))
            if e in held:
                out.append((s, e, held[e], at, later, r, None))
        known[s, c] = at
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r[c] for c in ("source", "entity_id", "content", "valid_from", "valid_to", "recorded_from", "recorded_to")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("split", [(7,), (2, 3, 2)])
def test_any_split_into_batches(spark, tmp_path, split):
    at = 0
    for batch, n in enumerate(split):
        part = spark.createDataFrame(rows(COMMITS[at: at + n]), live.VERSION)
        # a commit repeated within a batch is another batch's in a source that keeps its order
        if n == 7:
            first = spark.createDataFrame(rows(COMMITS[:4] + COMMITS[6:]), live.VERSION)
            live.store_batch(first, 0, str(tmp_path))
            break
        for _ in range(2 if batch == 1 else 1):  # the second batch comes twice
            live.store_batch(part, batch, str(tmp_path))
        at += n
    assert result(live._at(spark, str(tmp_path), batch)[0]) == expected()
    if len(split) > 1:
        told = [tuple(r)[1:3] for b in range(3) for r in spark.read.parquet(f"{tmp_path}/{b}/outcomes").collect()]
        assert sorted(told) == sorted([("c1", "stored"), ("c3", "stored"), ("c1", "stored"), ("c2", "stored"), ("c1", "repeated"), ("c3", "refused"), ("c4", "stored")])


def test_as_a_stream(spark, tmp_path):
    spark.createDataFrame(rows(COMMITS[:2]), live.VERSION).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = live.store_versions(spark.readStream.schema(live.VERSION).parquet(str(tmp_path / "in")))
    after, known, _ = live.store_commits(*live._at(spark, "", -1), spark.createDataFrame(rows(COMMITS[:2]), live.VERSION))
    assert result(got) == result(after) and known.count() == 2
    assert {r["closed_by"] for r in got.where("recorded_to IS NOT NULL").collect()} == {"c3"}
