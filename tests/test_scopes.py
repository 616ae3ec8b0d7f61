"""Vectors in spaces and sources, catalogue filters, and what pages wait for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import predicates, search, writer


@pytest.mark.parametrize("block", [4_096, 7])
def test_scoped_neighbours(spark, block):
    rng = np.random.default_rng(3)
    rows = [(s, space, i, rng.integers(0, 3, size).astype(float).tolist()) for s in ("a", "b", "c") for space, size in (("x", 3), ("y", 5)) for i in range(20)]
    rows.append(("a", "x", 99, None))
    asked = [(space, n, rng.integers(0, 3, size).astype(float).tolist()) for space, size in (("x", 3), ("y", 5)) for n in range(10)]
    v = spark.createDataFrame(rows, "source string, space string, item long, embedding array<double>")
    q = spark.createDataFrame([*asked, ("z", 1, [1.0])], "space string, query_id long, embedding array<double>")
    want = {}
    for space, n, y in asked:
        near = sorted((round(float(np.linalg.norm(np.array(x) - y)), 6), s, i) for s, sp, i, x in rows if sp == space and x and s in ("a", "c"))
        want |= {(space, n, k + 1): (s, i, d) for k, (d, s, i) in enumerate(near[:4])}
    got = search.scoped_neighbours(v, q, ["a", "c"], "l2", 4, block)
    assert {(r["space"], r["query_id"], r["rank"]): (r["source"], r["item"], r["distance"]) for r in got.collect()} == want
    assert search.scoped_neighbours(v, q, [], "l2", 4).count() == 0
    with pytest.raises(ValueError):
        search.scoped_neighbours(v, q, ["a"], "other", 4)
    ids = v.where("source = 'a' AND space = 'x'").select(F.col("item").alias("vec_id"), "embedding")
    one, two = (sorted(map(tuple, search.exact_neighbours(ids, ids.where("vec_id % 2 = 0"), "l2", 3, b).collect())) for b in (4_096, block))
    assert one == two and len(one) == 30 and all(r[0] != r[2] for r in one)


def test_catalogue_filters(spark):
    texts = ["apple", "Banana", "cherry", "éclair", "Zoo", "a%b", "a.b", "axb", "a\nb", "a\n", None, "50%"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, v string")

    def held(**clauses):
        return {texts[r["id"]] for r in predicates.where(rows, {"v": {f"_{k}": x for k, x in clauses.items()}}, predicates.CATALOGUE).collect()}

    every = set(texts)
    assert held(eq=None) == {None} and held(neq=None) == every - {None}
    assert held(nin=["Zoo", None]) == every - {"Zoo", None} and held(nin=["Zoo"]) == every - {"Zoo"} and held(**{"in": [None, "Zoo"]}) == {None, "Zoo"} and held(**{"in": []}) == set()
    assert held(contains="%") == {"a%b", "50%"} and held(contains="AN") == {"Banana"}
    assert held(like="a_b") == {"a%b", "a.b", "axb"} and held(like="a.b") == {"a.b"} and held(like="a%") == {"apple", "a%b", "a.b", "axb"} and held(like="A%") == set()
    # by locale: capitals beside small letters, accents beside their letter
    assert held(gt="banana", lt="zoo") == {"Banana", "cherry", "éclair"} and held(lt=None) == set()
    assert held(is_null=True) == {None} and held(is_null=False) == every - {None}
    order = [r["v"] for r in rows.where("id IN (0, 1, 2, 3, 4, 10)").orderBy(*predicates.catalogue_ordering([("v", "DESC")], rows, "id")).collect()]
    assert order == ["Zoo", "éclair", "cherry", "Banana", "apple", None]
    with pytest.raises(ValueError):
        predicates.where(rows, {"v": {"_near": 1}}, predicates.CATALOGUE)


def test_refresh(spark):
    pages = spark.createDataFrame([("product:a",), ("domain:b",), ("domain:c",)], "page string")
    links = spark.createDataFrame([("domain:b", "svc"), ("domain:c", "svc"), ("domain:c", "domain:b"), ("domain:gone", "svc")], "page string, entry string")
    items = [
        ("question", "q1", "answered", False, ["svc"], None), ("question", "q2", "answered", True, ["svc"], None), ("question", "q3", "open", False, ["svc"], None),
        ("question", "q4", "answered", None, ["nothing", "domain:b"], "product:a"), ("question", "q5", "answered", False, [], "domain:gone"), ("question", "q6", "answered", False, ["domain:x#svc"], None),
        ("correction", "c1", "open", None, ["domain:c#s1#s2"], None), ("correction", "c2", "open", None, ["domain:c#"], None), ("correction", "c3", "closed", None, ["domain:c"], None), ("correction", "q1", "open", None, ["svc2"], None),
    ]
    items = spark.createDataFrame(items, "kind string, slug string, status string, resolved boolean, about array<string>, asked_in string")
    grounds = spark.createDataFrame([("domain:b", "g1", "changed"), ("domain:b", "g2", "same"), ("domain:gone", "g3", "removed"), ("product:a", "g4", "removed")], "page string, ground string, status string")
    want = {
        ("domain:b", "answer", "q1"), ("domain:c", "answer", "q1"), ("domain:b", "answer", "q4"), ("product:a", "answer", "q4"), ("domain:c", "correction", "c1"), ("domain:b", "ground-changed", "g1"), ("product:a", "ground-removed", "g4"),
    }
    assert {tuple(r) for r in writer.refresh_reasons(pages, links, items, grounds).collect()} == want
    assert {tuple(r) for r in writer.refresh_reasons(pages, links, items, grounds, True).collect()} - want == {(p, "language", None) for p in ("product:a", "domain:b", "domain:c")}
    assert {(r["kind"], r["slug"]) for r in writer.unplaced(pages, links, items).collect()} == {("question", "q5"), ("question", "q6"), ("correction", "c2"), ("correction", "q1")}
