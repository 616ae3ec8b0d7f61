"""Periods and dates of files over small histories: backdated commits, side branches, merges, renames, boundaries."""

import random

import pytest

from tessera.operators import history


def frames(spark, commits, parents, changes, tree):
    """commits: (id, date, boundary) in ancestry order; changes: (commit, path, change, previous)."""
    c = spark.createDataFrame([("r", i, at, n, b) for n, (i, at, b) in enumerate(commits)], "repository string, commit_id string, committed_at long, position long, boundary boolean")
    p = spark.createDataFrame(parents, "commit_id string, place int, parent string")
    x = spark.createDataFrame([("r", *row, n) for n, row in enumerate(changes)], "repository string, commit_id string, path string, change string, previous string, place long")
    t = spark.createDataFrame([("r", path) for path in tree], "repository string, path string")
    pin = spark.createDataFrame([("r", commits[-1][0])], "repository string, commit_id string")
    return x, c, p, pin, t


def run(spark, *args):
    out = history.path_periods(*frames(spark, *args)).collect()
    return {r["path"]: (r["commit_count"], r["last_change"], r["added_in"], r["added_at"], r["removed_in"], r["removed_at"]) for r in out}


def test_backdated_deletion_on_a_side_branch(spark):
    """f.txt lives on a side branch only; its deletion bears an older date than its addition."""
    commits = [("root", 1, False), ("add", 10, False), ("delete", 2, False), ("main", 5, False), ("merge", 12, False)]
    parents = [("add", 0, "root"), ("delete", 0, "add"), ("main", 0, "root"), ("merge", 0, "main"), ("merge", 1, "delete")]
    got = run(spark, commits, parents, [("root", "README", "added", None), ("add", "f", "added", None), ("delete", "f", "deleted", None)], ["README", "new"])
    assert got == {"README": (1, 1, "root", 1, None, None), "f": (2, 10, "add", 10, "delete", 2), "new": (0, None, None, None, None, None)}


def test_merges(spark):
    """A removal that the merge makes is the merge's; one that it discards is none."""
    commits = [("a", 1, False), ("side", 2, False), ("main", 3, False), ("merge", 4, False)]
    parents = [("side", 0, "a"), ("main", 0, "a"), ("merge", 0, "main"), ("merge", 1, "side")]
    changes = [("a", "f", "added", None), ("a", "g", "added", None), ("side", "f", "deleted", None), ("side", "g", "deleted", None), ("merge", "f", "deleted", None)]
    got = run(spark, commits, parents, changes, ["g"])
    assert got == {"f": (3, 4, "a", 1, "merge", 4), "g": (2, 2, "a", 1, None, None)}


def test_renames_twice_and_boundaries(spark):
    commits = [("b", 1, True), ("c", 2, False), ("d", 3, False), ("e", 4, False)]
    parents = [("c", 0, "b"), ("d", 0, "c"), ("e", 0, "d")]
    changes = [("b", "old", "added", None), ("c", "new", "renamed", "old"), ("c", "twice", "added", None), ("d", "twice", "deleted", None), ("d", "lost", "added", None), ("e", "twice", "added", None), ("e", "only", "modified", None)]
    got = run(spark, commits, parents, changes, ["new", "twice"])
    assert got["old"] == (1, 1, None, None, "c", 2)  # nothing begins at a boundary
    assert got["new"] == (1, 2, "c", 2, None, None)
    assert got["twice"] == (3, 4, "e", 4, None, None)
    assert got["lost"] == (1, 3, "d", 3, "e", 4)  # absent from the tree without a deletion: it ends at the pin
    assert got["only"] == (1, 4, None, None, None, None)


def test_first_parents_of_long_chains(spark):
    n = 1_000
    links = [(i, 0, i - 1) for i in range(1, n)] + [(i, 1, i - 7) for i in range(7, n, 5)] + [(5_000 + i, 0, 4_999 + i) for i in range(1, 9)]
    parents = spark.createDataFrame(links, "commit_id long, place int, parent long")
    got = history.first_parents(spark.createDataFrame([("a", n - 1), ("b", 5_003), ("c", 0)], "repository string, commit_id long"), parents).collect()
    assert len(got) == n + 4 + 1
    assert {(r["repository"], r["commit_id"], r["steps"]) for r in got} == {("a", i, n - 1 - i) for i in range(n)} | {("b", 5_003 - i, i) for i in range(4)} | {("c", 0, 0)}


def test_dates_follow_the_walk(spark):
    rng = random.Random(3)
    rows = [("r", rng.choice("abc"), i, rng.randrange(100), rng.choice("xyz"), rng.randrange(30)) for i in range(60)]
    rooted = [("a", "a"), ("b", "a"), ("c", "c")]
    got = history.file_dates(spark.createDataFrame(rows, "repository string, file string, commit_id long, committed_at long, author string, walk long"), spark.createDataFrame(rooted, "file string, root string"))
    for r in got.collect():
        mine = [x for x in rows if dict(rooted)[x[1]] == r["root"]]
        first, last = min(mine, key=lambda x: (-x[5], x[2])), min(mine, key=lambda x: (x[5], x[2]))
        assert tuple(r)[2:] == (len(mine), len({x[4] for x in mine}), first[2], first[3], first[4], last[2], last[3], last[4])
    assert got.count() == 2


@pytest.mark.parametrize("n", [0, 1])
def test_no_history(spark, n):
    got = run(spark, [("a", 1, False)], [], [], ["f"][:n])
    assert got == {"f": (0, None, None, None, None, None)} if n else got == {}


def test_replay_of_vertices_edges_and_opinions(spark):
    """Random journals against a plain replay: what hangs on a vertex goes and comes with it."""
    from tessera.operators import temporal

    rng = random.Random(11)
    rows = []
    for seq in range(400):
        a, b = rng.choice("abcd"), rng.choice("abcd")
        what, name, ends = rng.choice([("vertex", a, []), ("edge", f"{a}>{b}", [a, b]), ("opinion", f"{a}/x", [a])])
        rows.append((seq, what, name, rng.random() < 0.5, ends))
    for n in (0, 10, 50, 400):
        last = {(w, i): (seq, opens, ends) for seq, w, i, opens, ends in rows[:n]}
        up = {i for (w, i), x in last.items() if w == "vertex" and x[1]}
        want = {(w, i, seq, sum(r[1] == w and r[2] == i for r in rows[:n])) for (w, i), (seq, opens, ends) in last.items() if opens and set(ends) <= up}
        got = temporal.replay_graph(spark.createDataFrame(rows[:n], "seq long, what string, id string, opens boolean, ends array<string>"))
        assert {tuple(r) for r in got.collect()} == want
