"""Generations rechecked by what they themselves have read."""

from tessera.operators import writer


def test_a_consumer_of_a_changed_kind_stays_fresh(spark):
    generations = [
        (1, "a", "now", "published", "i", "v"), (2, "a", "now", "running", "i", "v"), (3, "b", "old", "published", "i", "v"), (4, "b", "old", "published", "i", "v"), (5, "c", "old", "published", "i", "v"),
        (6, "b", "old", "stale", "i", "v"), (7, "b", "old", "published", "i", "v"), (8, "b", "old", "published", "i", "v"), (9, "a", "now", "failed", "i", "v"), (10, "a", "now", "ready", "i", "v"), (11, "a", "now", "published", "i", "v"),
    ]
    keys = [(i, "j" if i == 10 else "i", "w" if i == 11 else "v") for i in range(1, 12)]
    reads = [(1, "k", "x", "1"), (2, "k", "y", "old"), (3, "k", "x", "1"), (4, "k", "x", "1"), (4, "k", "y", "old"), (4, "l", "a", "old"), (5, "k", "y", "old"), (7, "k", "new", None), (7, "k", "none", None), (8, "k", "gone", "1"), (11, "k", "y", "old")]
    facts = [("k", "x", "1"), ("k", "y", "2"), ("k", "new", "3"), ("l", "a", "1")]
    make = spark.createDataFrame
    got = writer.recheck(
        make(generations, "generation int, stage string, run string, state string, inputs string, versions string"), make(keys, "generation int, inputs string, versions string"), make(reads, "generation int, kind string, key string, digest string"),
        make(facts, "kind string, key string, digest string"), make([("k",)], "kind string"), make([("b", "k"), ("b", "l"), ("c", "l")], "stage string, kind string"), "now",
    )
    assert {r["generation"]: (r["fresh"], r["cause"]) for r in got.collect()} == {
        1: (True, None), 2: (True, None), 3: (True, None), 4: (False, "read k y has moved"), 7: (False, "read k new is no longer empty"), 8: (False, "read k gone is gone"), 10: (False, "inputs have moved"), 11: (False, "versions have moved"),
    }
