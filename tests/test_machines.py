"""The fold of a state machine against a plain loop, over many ranges and in a stream."""

import os
import random

import pytest

from tessera.operators.machines import Machine, Step, follow
from tessera.plans.writer import VISIT

GUARDS = {"priced": lambda k, v: k > 20, "affordable": lambda k, v: v < 150, "severe": lambda k, v: k % 3 == 0}


def by_loop(rows):
    out, now = {}, {}
    for user, n, event, k, v in sorted(rows, key=lambda r: r[1]):
        before = now.get(user, "new")
        after, transition, code, guard = VISIT.step(before, event, frozenset(g for g, f in GUARDS.items() if k is not None and v is not None and f(k, v)))
        out[n] = (before, after, transition, code, guard)
        now[user] = after
    return out


def some(n, seed, hot):
    rng = random.Random(seed)
    return [(rng.choice([1] * hot + [2, 3, 4, None]), i, rng.choice(["signup", "view", "click", "purchase", "error", "other", None]), rng.randint(0, 60), rng.random() * 300) for i in range(n)]


@pytest.mark.parametrize("hot", [1, 40])
def test_one_subject_of_most_events(spark, hot):
    rows = some(3_000, hot, hot)
    got = follow(VISIT, spark.createDataFrame(rows, "user long, n long, event string, k long, value double"), "user", ["n"], "event")
    assert {r["n"]: tuple(r[c] for c in ("before", "after", "transition", "code", "guard")) for r in got.collect()} == by_loop(rows)
    sizes = got.groupBy(got.user).count().agg({"count": "max"}).first()[0]
    assert hot == 1 or sizes > 2_000
    # the largest subject isn't one task's
    assert got.rdd.mapPartitions(lambda p: [sum(r["user"] == 1 for r in p)]).filter(bool).count() > (hot > 1) * 2


def test_stored_states(spark):
    df = spark.createDataFrame([("a", 1, "view", "active"), ("a", 2, "purchase", "active"), ("b", 1, "signup", None), ("c", 1, "view", "odd"), ("c", 2, "view", "odd")], "s string, n int, e string, stored string")
    machine = Machine("m", "new", ("new", "active"), (Step("new", "signup", "active"), Step("active", "view", "active"), Step("active", "purchase", "new")))
    got = {(r["s"], r["n"]): (r["before"], r["after"], r["code"]) for r in follow(machine, df, "s", ["n"], "e", "stored").collect()}
    assert got == {("a", 1): ("active", "active", None), ("a", 2): ("active", "new", None), ("b", 1): ("new", "active", None), ("c", 1): ("odd", "odd", "m/unknown-state"), ("c", 2): ("odd", "odd", "m/unknown-state")}
    assert follow(machine, df.limit(0), "s", ["n"], "e").count() == 0


def test_refusals_name_the_closest_guard():
    machine = Machine("m", "a", ("a", "b"), (Step("a", "go", "b", ("x", "y", "z")), Step("a", "go", "b", ("y", "w"), "second"), Step("b", "go", "b")), dict.fromkeys("wxyz", "true"))
    assert machine.step("a", "go", frozenset()) == ("a", None, "m/guard-refused", "x")
    assert machine.step("a", "go", frozenset("y")) == ("a", None, "m/guard-refused", "x")
    assert machine.step("a", "go", frozenset("xz")) == ("a", None, "m/guard-refused", "y")
    assert machine.step("a", "go", frozenset("yw")) == ("b", "m/a--go-second-->b", None, None)
    assert machine.step("b", "go", frozenset()) == ("b", "m/b--go-->b", None, None)
    assert machine.mermaid().splitlines()[:3] == ["stateDiagram-v2", "  [*] --> a", "  a --> b: go [x & y & z]"]


@pytest.mark.parametrize(
    "states, steps, guards",
    [(("a", "a"), (), {}), (("b",), (), {}), (("a", "b"), (), {}), (("a",), (Step("a", "x", "c"),), {}), (("a",), (Step("a", "x", "a"), Step("a", "x", "a")), {}), (("a",), (Step("a", " ", "a"),), {}), (("a",), (Step("a", "x", "a", ("g",)),), {})],
)
def test_wrong_tables_are_refused(states, steps, guards):
    with pytest.raises(ValueError, match="machine m"):
        Machine("m", "a", states, steps, guards)


def test_stream_equals_batch(spark, tmp_path):
    """Rows in wrong order and over several micro-batches."""
    from tessera.streaming import live

    rng = random.Random(9)
    rows = [(u, i, e, k, v) for u, i, e, k, v in some(300, 8, 3) if u is not None]
    files = [rows[:100], rows[100:200], rows[200:]]
    for i, part in enumerate(files):
        rng.shuffle(part)
        before = set((tmp_path / "in").glob("*.json"))
        spark.createDataFrame(part, "user long, n long, event string, k long, value double").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        for file in set((tmp_path / "in").glob("*.json")) - before:
            os.utime(file, (1_000_000 + i, 1_000_000 + i))  # files are read in the order of their times
    source = spark.readStream.schema("user long, n long, event string, k long, value double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    stream = source.selectExpr("user AS subject", "n AS seq", "event", "k", "value", "timestamp_seconds(n * 60 + 86400) AS ts")
    got = {r["seq"]: (r["before"], r["after"], r["transition"], r["code"], r["guard"]) for r in live.run(live.follow(stream, VISIT, "3 hours")).collect()}
    newest = max(r[1] for r in rows)
    assert got == {n: x for n, x in by_loop(rows).items() if n < newest - 180} and len(got) > 100
