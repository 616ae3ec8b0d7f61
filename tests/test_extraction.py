"""Plugins as table functions, and what of their answers is refused."""

import pytest

from tessera.operators import extraction as E

CONTRACT = E.Contract({"file": {"lines": E.Field("integer"), "mode": E.Field("text", True), "facts": E.Field("json")}, "folder": {}}, {"holds": (["folder"], ["file", "folder"], {"at": E.Field("timestamp")})})


def plugin(row):
    yield E.vertex("folder", row.name)
    yield E.vertex("file", f"{row.name}/good", lines=3, mode="644", facts='{"a": 1}')
    yield E.vertex("file", f"{row.name}/wrong", lines="three", mode="644", facts="{")
    yield E.vertex("file", f"{row.name}/bare", lines=None)
    yield E.vertex("other", "x")
    yield E.edge("holds", ("folder", row.name), ("file", f"{row.name}/good"), at="2026-01-01 00:00:00")
    yield E.edge("holds", ("folder", row.name), ("file", f"{row.name}/wrong"), by="me")
    yield E.edge("holds", ("folder", row.name), ("folder", "known"))
    yield E.edge("holds", ("file", f"{row.name}/good"), ("folder", row.name))
    if row.n > 1:
        raise OSError("unreadable")


def test_answers_and_refusals(spark):
    units = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    found = E.answers(units, "name", plugin).cache()
    assert [(r["unit"], r["message"]) for r in found.where("what = 'problem'").collect()] == [("b", "OSError: unreadable")]
    good, refused = E.judged(found, CONTRACT, spark.createDataFrame([("folder", "known")], "kind string, key string"))
    assert {(r["id"], r["rule"], r["name"]) for r in refused.where("unit = 'a'").collect()} == {
        ("a/wrong", "wrong-type", "lines"), ("a/wrong", "wrong-type", "facts"), ("a/bare", "missing-field", "mode"), ("x", "undeclared-kind", None), ("a>a/wrong", "undeclared-field", "by"),
        ("a>a/wrong", "end-missing", "to"), ("a/good>a", "end-not-allowed", "from"),
    }
    assert {(r["what"], r["id"]) for r in good.where("unit = 'b'").collect()} == {("vertex", "b"), ("vertex", "b/good"), ("edge", "b>b/good"), ("edge", "b>known")}


def test_contracts_that_name_what_they_lack():
    with pytest.raises(ValueError, match="f.x"):
        E.Contract({"f": {"x": E.Field("number")}})
    with pytest.raises(ValueError, match="e: g"):
        E.Contract({"f": {}}, {"e": (["f"], ["g"], {})})
    with pytest.raises(ValueError, match="twice"):
        E.Contract({"f": {}}, {"f": (["f"], ["f"], {})})
