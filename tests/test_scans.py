"""Scans over ranges, as-of joins and strongly connected components against plain code on random data."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import cycles, graph, telemetry, temporal
from tessera.operators.ranges import dealt, running


@pytest.mark.parametrize("groups", [1, 3, 200])
@pytest.mark.parametrize("how", ["sum", "max", "last"])
@pytest.mark.parametrize("own", [True, False])
def test_running_equals_one_window(spark, groups, how, own):
    rng = random.Random(groups)
    rows = [(rng.choice([None, *range(groups)]), i, rng.choice([None, rng.randrange(100)])) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, i long, v long")
    got = running(dealt(df, "g", [F.col("i")]), "g", [F.col("i")], "out", F.col("v"), how, own)
    of = {"sum": F.coalesce(F.sum("v").over(w := W.partitionBy("g").orderBy("i").rowsBetween(W.unboundedPreceding, 0 if own else -1)), F.lit(0)), "max": F.max("v").over(w), "last": F.last("v", True).over(w)}[how]
    assert {(r["i"], r["out"]) for r in got.collect()} == {(r["i"], r["out"]) for r in df.select("i", of.alias("out")).collect()}
    assert got.select("__range").distinct().count() > 1


def test_islands_of_one_long_trace(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2]), s := rng.randrange(3_000), s + rng.randrange(12)) for _ in range(900)]
    expected = set()
    for k in (1, 2):
        before = None
        mine = sorted((s, e) for g, s, e in rows if g == k and s < e)
        start, end = mine[0]
        for s, e in [*mine[1:], (10**9, 10**9 + 1)]:
            if s > end:
                expected.add((k, start, end, before))
                start, before, end = s, end, e
            end = max(end, e)
    assert {tuple(r) for r in telemetry.islands(spark.createDataFrame(rows, "k long, s long, e long"), "k", "s", "e").collect()} == expected


def test_recorded_times_of_one_source(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), i, rng.randrange(200)) for i in range(600)]
    got = temporal.recorded_times(spark.createDataFrame(rows, "source string, seq long, clock long"), "source", "seq", "clock")
    last, expected = {}, set()
    for source, i, clock in rows:
        last[source] = clock if source not in last or clock > last[source] else last[source] + 1
        expected.add((source, i, clock, last[source]))
    assert {tuple(r) for r in got.collect()} == expected


@pytest.mark.parametrize("overlapping", [False, True])
def test_asof_join_equals_all_pairs(spark, overlapping):
    rng = random.Random(5)
    versions = []
    for key in (1, 1, 1, 2, 3):
        at = 0
        for _ in range(60):
            start = rng.randrange(1_000) if overlapping else at + rng.randrange(4)
            end = start + 1 + rng.randrange(300 if overlapping and rng.random() < 0.2 else 9)
            versions.append((key if not overlapping else rng.choice([1, 1, 2]), f"v{len(versions)}", start, None if overlapping and rng.random() < 0.05 else end))
            at = end
    if not overlapping:
        versions = [v for i, v in enumerate(versions) if v[0] != 1 or i < 60]
    versions += [(1, "empty", 5, 5), (None, "no key", 0, None), (4, "no start", None, 9)]
    probes = [(i, rng.choice([1, 1, 1, 2, 3, 9, None]), rng.choice([None, *range(1_000)])) for i in range(700)]
    got = temporal.as_of_join(spark.createDataFrame(probes, "id long, user long, moment long"), spark.createDataFrame(versions, "entity_id long, content string, valid_from long, valid_to long"), "user", "moment")
    expected = sorted((i, u, m, c) for i, u, m in probes for k, c, s, e in versions if u is not None and u == k and m is not None and s is not None and s <= m and (e is None or e > m))
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 100


def by_force(edges):
    out, nodes = {}, {x for e in edges for x in e}
    reach = {x: {x} for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                changed = True
    for x in nodes:
        out[x] = min(y for y in reach[x] if x in reach[y])
    return out


def labelled(df):
    return {r["id"]: r["component"] for r in df.collect()}


@pytest.mark.parametrize("seed, nodes, edges", [(1, 30, 40), (4, 60, 66)])
def test_components_of_random_graphs(spark, seed, nodes, edges):
    rng = random.Random(seed)
    links = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]
    df = spark.createDataFrame([*links, (None, 1), (2, None)], "src long, dst long")
    assert labelled(cycles.components(df)) == by_force(links)
    on = {r["id"] for r in graph.on_cycles(df.where("src IS NOT NULL AND dst IS NOT NULL")).collect()}
    sizes = by_force(links)
    assert on == {x for x in sizes if sum(c == sizes[x] for c in sizes.values()) > 1 or (x, x) in links}


def test_components_of_knots(spark):
    """Circles that hang together by single nodes, ways into and out of them, and an eight."""
    links = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3), (5, 6), (6, 7), (8, 1), (9, 8), (7, 10), (10, 11), (11, 12), (12, 10), (20, 20), (20, 21), (30, 31), (31, 30), (31, 32), (32, 33), (33, 31), (33, 34)]
    assert labelled(cycles.components(spark.createDataFrame(links, "src long, dst long"))) == by_force(links)


def test_components_of_a_large_ring(spark):
    n = 100_000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst")).unionByName(spark.range(n, n + 50).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    got = cycles.components(ring).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    assert {r["component"]: r["n"] for r in got.collect()} == {0: n} | {i: 1 for i in range(n, n + 51)}


def test_no_components(spark):
    assert cycles.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_starved_beyond_any_number_of_steps(spark):
    needs = [(i, i + 1) for i in range(70)]
    got = graph.starved(spark.createDataFrame(needs, "stage long, capability long"), spark.createDataFrame([(i, i) for i in range(70)], "stage long, capability long"))
    assert {r["stage"]: r["steps"] for r in got.collect()} == {i: 70 - i for i in range(70)}


def test_view_of_a_deep_tree_fails(spark):
    elements = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 1)], "id long, parent long")
    relations = spark.createDataFrame([(1, 4, 5)], "id long, src long, dst long")
    assert [tuple(r)[:3] for r in graph.view(elements, relations, 1, 1, levels=3).collect()] == [(2, 5, 1)]
    with pytest.raises(Exception, match="deeper than 2 levels"):
        graph.view(elements, relations, 1, 1, levels=2).collect()
