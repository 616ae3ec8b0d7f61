"""Operators on hand-made frames: nulls, ties, empty inputs, boundary cases."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import identity
from tessera.operators import aggregates, connections, cycles, graph, opinions, predicates, quality, rules, search, telemetry, temporal, writer
from tessera.sources import files, tails
from tessera.streaming import live

OP = "id long, holder long, producer string, said_by string, said_at long, lang string, grade string, amount long, title string, evidence string, state string"


def op(i, holder, producer="a", lang=None, grade=None, amount=None, title=None, evidence="e", state="open"):
    return (i, holder, producer, f"{producer}@1", i, lang, grade, amount, title, evidence, state)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_agreement_ignores_nulls_and_closed(spark):
    df = spark.createDataFrame([op(1, 1, grade="x"), op(2, 1, grade=None), op(3, 2, grade="x"), op(4, 2, grade="y"), op(5, 3, grade="z", state="closed"), op(6, 4)], OP)
    assert as_set(opinions.agree(df, "holder", ["grade"])) == {(1, "x"), (2, None), (4, None)}
    assert as_set(opinions.contested(df, "holder", ["grade", "amount"])) == {(2, "grade")}


@pytest.mark.parametrize(("langs", "shown"), [(["de", "en", None], {"t0"}), (["en", None], {"t0"}), ([None, "fr"], {"t0"}), (["fr"], set())])
def test_language_choice(spark, langs, shown):
    df = spark.createDataFrame([op(i, 1, lang=x, title=f"t{i}") for i, x in enumerate(langs)], OP)
    assert {r["title"] for r in opinions.choose_language(df, "holder", "title", "de", "en").collect()} == shown
    assert {r["title"] for r in opinions.label_language(df, "holder", "title", "de", "en").collect()} == (shown or {"t0"})


def test_language_needs_a_value(spark):
    df = spark.createDataFrame([op(1, 1, lang="de", title=None), op(2, 1, lang="en", title="x")], OP)
    assert [r["title"] for r in opinions.choose_language(df, "holder", "title", "de", "en").collect()] == ["x"]


def test_refinement_takes_the_last_declared(spark):
    df = spark.createDataFrame([op(1, 1, "a", grade="x"), op(2, 1, "b", grade=None), op(3, 2, "b", grade="y"), op(4, 2, "a", grade="x")], OP)
    assert as_set(opinions.refine(df, "holder", "grade", ["a", "b"])) == {(1, "x"), (2, "y")}


ROWS = [(i, a, b) for i, (a, b) in enumerate(itertools.product([None, 1, 2, 2], [None, 5, 6]))]


@pytest.mark.parametrize(("d1", "n1", "d2", "n2"), itertools.product(["ASC", "DESC"], ["FIRST", "LAST"], ["ASC", "DESC"], ["FIRST", "LAST"]))
def test_keyset_pages_cover_everything_once(spark, d1, n1, d2, n2):
    df = spark.createDataFrame(ROWS, "id long, a long, b long").cache()
    order = [("a", d1, n1), ("b", d2, n2)]
    want = [r["id"] for r in df.orderBy(*predicates.ordering(order, "id")).collect()]
    for cut in (0, 4, 7, 10):
        r = df.where(F.col("id") == want[cut]).first()
        got = df.where(predicates.after(order, "id", [r["a"], r["b"]], r["id"])).orderBy(*predicates.ordering(order, "id")).collect()
        assert [x["id"] for x in got] == want[cut + 1:]


def test_cursor_codec():
    assert predicates.decode_cursor(predicates.encode_cursor([None, "x"], 3), 2) == ([None, "x"], 3)
    for bad in ("", None, "!!", "bm90IGpzb24", predicates.encode_cursor([1], 3)):
        assert predicates.decode_cursor(bad, 2) is None


def test_filters_on_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, v string")
    ids = lambda **c: {r["id"] for r in predicates.where(df, {"v": c}).collect()}
    assert ids(_eq=None) == {2} and ids(_neq="a") == {2, 3} and ids(_in=["a"]) == {1} and ids(_nin=["a"]) == {3}
    assert ids(_contains="A") == {1} and ids(_is_null=True) == {2} and ids(_is_null="x") == {1, 2, 3} and ids(_lt="b") == {1}
    with pytest.raises(ValueError):
        predicates.where(df, {"w": {"_eq": 1}})
    with pytest.raises(ValueError):
        predicates.where(df, {"v": {"_or": 1}})


@pytest.mark.parametrize(("glob", "yes", "no"), [("**/*.sql", ["a.sql", "x/y/a.sql"], ["a.sqlx"]), ("a?/*", ["ab/c"], ["a//c", "ab/c/d"]), ("src/**", ["src/a/b"], ["xsrc/a"])])
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(x,) for x in yes + no], "p string")
    assert {r["p"] for r in df.where(F.col("p").rlike(predicates.glob_regex(glob))).collect()} == set(yes)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (None,), (9.0,)], "v double")
    assert [tuple(r) for r in aggregates.histogram(df, "v", [5, 1, float("nan")]).collect()] == [(0, 1), (1, 2), (2, 1)]
    assert [r["n"] for r in aggregates.histogram(df.where("false"), "v", [1]).collect()] == [0, 0]


def test_group_by_orders_null_last(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "v string")
    assert [tuple(r) for r in aggregates.group_by(df, "v").collect()] == [("a", 1), ("b", 1), (None, 1)]


def test_connection_totals_and_lookahead(spark):
    df = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 9)], "p long, c long")
    got = connections.connection(df, "p", [F.asc("c")], 2).collect()
    assert {(r["p"], r["c"], r["total"], r["rn"]) for r in got} == {(1, 0, 5, 1), (1, 1, 5, 2), (1, 2, 5, 3), (2, 9, 1, 1)}


def test_closure_and_levels_with_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    assert as_set(graph.closure(e)) == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} | {(4, 5)}
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    assert as_set(graph.levels(e, nodes)) == {(5, 0), (6, 0), (4, 1)}
    assert as_set(graph.closure(e.where("false"))) == set()


def test_related_keeps_least_distance_and_live_nodes(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (3, 4)], "src long, dst long")
    o = spark.createDataFrame([(1,)], "id long")
    assert as_set(graph.related(o, e, 3)) == {(1, 2, 1), (1, 3, 1), (1, 4, 2)}
    assert as_set(graph.related(o, e, 3, spark.createDataFrame([(2,), (1,)], "id long"))) == {(1, 2, 1)}


def test_trail_stops_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (5, 6)], "src long, dst long")
    assert as_set(graph.trail(spark.createDataFrame([(1,), (5,), (9,)], "id long"), e, 4)) == {(1, "2"), (5, "6"), (9, "")}


def test_lifted_view(spark):
    parents = spark.createDataFrame([(11, 1), (12, 1), (21, 2), (211, 21)], "src long, dst long")
    shown = spark.createDataFrame([(1,), (2,)], "id long")
    rel = spark.createDataFrame([(11, 21), (12, 211), (11, 12)], "src long, dst long")
    got = graph.lifted(rel, graph.ancestors(parents, shown, 3), F.col("dst")).collect()
    assert [(r["from_id"], r["to_id"], r["n"]) for r in got] == [(1, 2, 2)]


A = "source string, kind string, entity_id long, content string, valid_from long, valid_to long, recorded_from long, recorded_to long, opened_by string, closed_by string"


def plain_store(rows, version, source, at, recorded, successor):
    """What a version writes, assertion by assertion."""
    out = []
    now = {(r[1], r[2]): r for r in rows if r[0] == source and r[7] is None and r[4] <= at and (r[5] is None or r[5] > at)}
    for key in now.keys() | version.keys():
        old, new = now.get(key), version.get(key)
        if old and new == old[3]:
            continue
        if old:
            out.append((*key, "closed", old[3], old[4], old[5]))
            if old[4] < at:
                out.append((*key, "truncated", old[3], old[4], at))
            if successor is not None and (old[5] is None or old[5] > successor):
                out.append((*key, "restored", old[3], successor, old[5]))
        if new and (successor is None or successor > at):
            out.append((*key, "opened", new, at, successor))
    return set(out)


@pytest.mark.parametrize("seed", [11, 29])
def test_store_version_against_plain_python(spark, seed):
    rng = random.Random(seed)
    rows = []
    for e in range(12):
        t = 0
        while t < 100 and rng.random() < 0.9:
            end = t + rng.randint(1, 40)
            rows.append((rng.choice(["s", "s", "z"]), "k", e, rng.choice("abc"), t, None if rng.random() < 0.2 else end, 0, None if rng.random() < 0.9 else 5, "c", None))
            t = end
    df = spark.createDataFrame(rows, A)
    for at, successor in ((0, None), (20, None), (20, 30), (50, 50)):
        version = {("k", e): rng.choice("abc") for e in range(14) if rng.random() < 0.7}
        v = spark.createDataFrame([(k, e, c) for (k, e), c in version.items()], "kind string, entity_id long, content string")
        # one state per entity, as a store keeps it
        once = {}
        for r in rows:
            if r[0] == "s" and r[7] is None and r[4] <= at and (r[5] is None or r[5] > at):
                once.setdefault(r[2], r)
        kept = [r for r in rows if not (r[0] == "s" and r[7] is None and r[4] <= at and (r[5] is None or r[5] > at)) or once[r[2]] is r]
        got = temporal.store_version(spark.createDataFrame(kept, A), v, "s", at, 1000, successor).collect()
        assert {(r["kind"], r["entity_id"], r["action"], r["content"], r["valid_from"], r["valid_to"]) for r in got} == plain_store(kept, version, "s", at, 1000, successor)
    assert df.count() == len(rows)


def test_snapshot_after_a_version(spark):
    df = spark.createDataFrame([("s", "k", 1, "a", 0, None, 0, None, "c0", None), ("s", "k", 2, "b", 0, None, 0, None, "c0", None)], A)
    v = spark.createDataFrame([("k", 1, "x"), ("k", 2, "b")], "kind string, entity_id long, content string")
    snap = files.next_snapshot(df, temporal.store_version(df, v, "s", 10, 100, None), "s", "c1")
    now = temporal.as_of(snap, 11, 101).select("entity_id", "content")
    before = temporal.as_of(snap, 11, 50).select("entity_id", "content")
    assert as_set(now) == {(1, "x"), (2, "b")} and as_set(before) == {(1, "a"), (2, "b")}


@pytest.mark.parametrize("seed", [11, 29])
def test_replay_against_plain_python(spark, seed):
    rng = random.Random(seed)
    kinds = ["open", "close", "again"]
    rows = [(rng.randint(1, 6), i, rng.choice(kinds)) for i in range(60)]
    state = {}
    for i, seq, kind in rows:
        s = state.setdefault(i, {"open": False, "since": None, "evidence": None, "n": 0})
        s["n"] += 1
        if kind == "again":
            s["evidence"] = seq
        else:
            s["open"], s["since"] = kind == "open", seq
    got = temporal.replay(spark.createDataFrame(rows, "id long, seq long, event_type string"), "id", "seq", ("open",), ("close",), ("again",))
    assert as_set(got) == {(i, s["since"], s["evidence"], s["n"]) for i, s in state.items() if s["open"]}


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 4), (1, 4, 6), (1, 2, 3), (1, 8, 9), (1, 7, 7), (2, 5, 6)], "k long, s long, e long")
    assert as_set(telemetry.islands(df, "k", "s", "e")) == {(1, 0, 6, None), (1, 8, 9, 6), (2, 5, 6, None)}
    spans = df.selectExpr("k AS trace", "row_number() OVER (ORDER BY k, s, e) AS span", "CAST(NULL AS INT) AS parent", "s AS started", "e AS ended")
    assert as_set(telemetry.uncovered(spans)) == {(1, 6, 8), (2, 5, 6)}  # a span that is all of its trace is the run itself


def test_self_time_counts_children_unclipped(spark):
    df = spark.createDataFrame([(1, None, "run", 0, 10), (2, 1, "a", 2, 4), (3, 1, "b", 6, 14)], "span long, parent long, name string, started long, ended long")
    assert as_set(telemetry.self_times(df)) == {(1, "run", 0), (2, "a", 2), (3, "b", 8)}


def test_meter_restarts(spark):
    df = spark.createDataFrame([(1, i, r) for i, r in enumerate([800, 1200, 100, 150])], "s long, n long, r long")
    assert [r["increment"] for r in telemetry.increments(df, "s", "n", "r").orderBy("n").collect()] == [800, 400, 100, 50]


def test_state_opinions(spark):
    old = spark.createDataFrame([op(1, 1, grade="x"), op(2, 2, grade="x"), op(3, 3, grade="x")], OP)
    new = spark.createDataFrame([op(11, 1, grade="x"), op(12, 2, grade="y"), op(13, 3, grade="x", evidence="f"), op(14, 4, grade="q"), op(15, 4, grade="z")], OP)
    got = writer.state_opinions(old, new, ["holder", "producer", "lang"], ["grade"], "id")
    assert {(r["holder"], r["new_id"], r["closes"], r["action"]) for r in got.collect()} == {(1, 11, None, "unchanged"), (2, 12, 2, "replaced"), (3, 13, None, "re-evidenced"), (4, 15, None, "opened")}


def test_membership_digest_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (1, None)], "g long, v string")
    b = spark.createDataFrame([(1, None), (1, "y"), (1, "x")], "g long, v string")
    assert as_set(writer.membership_digest(a, "g", ["v"])) == as_set(writer.membership_digest(b, "g", ["v"]))
    assert as_set(writer.membership_digest(a.where("v = 'x'"), "g", ["v"])) != as_set(writer.membership_digest(a.where("v = 'y'"), "g", ["v"]))


def test_shortest_prefixes(spark):
    uids = ["aaaa1", "aaaa2", "aaab0", "bcde0", "bcdf0"]
    got = temporal.shortest_prefixes(spark.createDataFrame([(u,) for u in uids], "u string"), "u")
    assert {r["u"]: r["prefix"] for r in got.collect()} == {"aaaa1": "aaaa1", "aaaa2": "aaaa2", "aaab0": "aaab", "bcde0": "bcde", "bcdf0": "bcdf"}


def test_search_ranks(spark):
    df = spark.createDataFrame([("k", 1, "Mango", "Mango", True), ("k", 2, "Human", "Human", True), ("k", 3, "x", "a man", False), ("k", 1, "Mango", "man", False)], "kind string, id long, label string, value string, is_title boolean")
    assert [(r["id"], r["rank"]) for r in search.flat(df, "man", 10).collect()] == [(1, 0), (2, 1), (3, 3)]


def test_redaction_and_names(spark):
    df = spark.createDataFrame([({"API-Key": "1", "colour": "2"}, "two words")], "m map<string,string>, n string")
    row = df.select(identity.redacted(F.col("m"), ["apikey"]).alias("m"), identity.pascal(F.col("n")).alias("n")).first()
    assert row["m"] == {"colour": "2"} and row["n"] == "TwoWords"


def test_file_sources(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"traceId":"t","spanId":"a","name":"n","startTimeUnixNano":"2000000","endTimeUnixNano":"5000000"}\n')
    r = files.traces(spark, str(tmp_path / "t.jsonl")).first()
    assert (r["start"], r["end"], r["failed"]) == (2.0, 5.0, False)
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception):
        files.traces(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "log").write_text("first line\nsecond\nthird\n")
    assert [(x["line"], x["truncated"]) for x in tails.tail(spark, str(tmp_path / "log"), 14).collect()] == [("second", True), ("third", True)][-len(tails.tail(spark, str(tmp_path / "log"), 14).collect()):]
    (tmp_path / "s").write_text("\x1eh1\x1fann\x1f2024-01-01T00:00:00Z\nA\tx.txt\nM\ty.txt\n\x1eh2\x1fbob\x1f2024-01-02T00:00:00Z\nD\tx.txt\n")
    (tmp_path / "n").write_text("\x1eh1\x1fann\x1f2024-01-01T00:00:00Z\n3\t0\tx.txt\n-\t-\ty.txt\n")
    got = files.change_log(spark, str(tmp_path / "s"), str(tmp_path / "n")).select("hash", "path", "status", "added")
    assert as_set(got) == {("h1", "x.txt", "A", 3), ("h1", "y.txt", "M", None), ("h2", "x.txt", "D", None)}
    for n in ("a", "b"):
        (tmp_path / f"{n}.jsonl").write_text('{"id":"1","level":"info","message":"m"}\n')
    rows_ = files.logs(spark, {n: str(tmp_path / f"{n}.jsonl") for n in "ab"}).collect()
    assert sorted(r["source"] for r in rows_) == ["a", "b"]


def test_no_operator_collects():
    import pathlib

    root = pathlib.Path(graph.__file__).parent
    for p in root.glob("*.py"):
        # search sends queries out in batches of a bounded number
        assert p.read_text().count(".collect()") == (p.name == "search.py") and ".toPandas()" not in p.read_text() and ".toArrow()" not in p.read_text(), p.name


# -- files, streams


@pytest.mark.parametrize("order", [1, -1])
def test_stream_meter_over_micro_batches(spark, tmp_path, order):
    """Rows of one hour over several files, in or out of order, one file a trigger: as the batch form."""
    rng = random.Random(order)
    base = 1_700_000_000_000
    rows = [(i % 3, i, rng.randrange(50), base + 60_000 * i) for i in range(40)]
    parts = [rows[i: i + 8] for i in range(0, 40, 8)][::order]
    schema = "session long, seq long, reading long, ms long"
    for n, part in enumerate(parts):
        df = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_millis("ms"))
        df.coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        source = next((tmp_path / f"part{n}").glob("*.parquet"))
        (tmp_path / "all").mkdir(exist_ok=True)
        target = tmp_path / "all" / f"{n}.parquet"
        source.rename(target)
        os.utime(target, (1_600_000_000 + n, 1_600_000_000 + n))
    stream = spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    got = {(r["session"], r["seq"]): r["increment"] for r in live.run(live.meter(stream, "2 hours" if order < 0 else "5 minutes")).collect()}
    batch = telemetry.increments(spark.createDataFrame(rows, schema), "session", "seq", "reading").collect()
    last = max(r[3] for r in rows) - (7_200_000 if order < 0 else 300_000)
    want = {(r["session"], r["seq"]): r["increment"] for r in batch if r["ms"] < last}
    assert got == want and (len(want) > 20 or order < 0)
    if order < 0:  # a newer row moves the watermark past all of them
        late = spark.createDataFrame([(9, 99, 1, base + 10_800_000)], schema).withColumn("ts", F.timestamp_millis("ms"))
        late.coalesce(1).write.parquet(str(tmp_path / "late"))
        next((tmp_path / "late").glob("*.parquet")).rename(tmp_path / "all" / "late.parquet")
        whole = {(r["session"], r["seq"]): r["increment"] for r in live.run(live.meter(stream, "2 hours")).collect()}
        assert whole == {(r["session"], r["seq"]): r["increment"] for r in batch}


def test_stream_of_traces(spark, tmp_path):
    line = '{{"traceId":"t","spanId":"{0}","name":"n","startTimeUnixNano":"{0}000000","endTimeUnixNano":"{0}500000","attributes":{{"a":"1"}}}}\n'
    (tmp_path / "a.jsonl").write_text("".join(line.format(i) for i in (1, 2)))
    (tmp_path / "b.jsonl").write_text(line.format(3))
    got = live.run(live.trace_source(spark, str(tmp_path), 1)).orderBy("spanId").collect()
    assert got == files.traces(spark, str(tmp_path)).orderBy("spanId").collect() and [r["start"] for r in got] == [1.0, 2.0, 3.0]


def test_tree_dump(spark, tmp_path):
    (tmp_path / "tree").write_bytes(b"100644 blob aa      12\tsrc/a b.ts\x00120000 blob bb     900\tlogo.png\x00160000 commit cc       -\tvendor\x00")
    (tmp_path / "counts").write_bytes(b"3\t0\tsrc/a b.ts\x00-\t-\tlogo.png\x00")
    got = {r["path"]: (r["mode"], r["kind"], r["bytes"], r["lines"], r["binary"]) for r in files.tree(spark, str(tmp_path / "tree"), str(tmp_path / "counts")).collect()}
    assert got == {"src/a b.ts": ("100644", "blob", 12, 3, False), "logo.png": ("120000", "blob", 900, None, True), "vendor": ("160000", "commit", None, None, None)}


def test_log_rows(spark, tmp_path):
    (tmp_path / "engine").mkdir()
    (tmp_path / "engine" / "x.jsonl").write_text(
        '{"at":1,"level":"error","message":"src/a.ts:12: failed","fields":{"unit":"u","api_key":"s"}}\n'
        '{"at":2,"level":"info","message":"m","code":"step","detail":"' + "d" * (files.MAX_DETAIL + 5) + '"}\n'
    )
    a, b = files.logs(spark, {"engine": str(tmp_path / "engine")}).orderBy("at").collect()
    assert (a["file"], a["line"], a["quoted"], a["cut"], a["fields"]) == ("src/a.ts", 12, True, False, {"unit": "u"})
    assert (b["quoted"], b["cut"], len(b["detail"]), b["file"]) == (False, True, files.MAX_DETAIL, None) and a["id"] != b["id"]
    assert list(a.asDict()) == list(files.LOG)


# -- the rest of this round


def test_uncovered_golden(spark):
    """A run of 10 ms with spans (2, 4) and (6, 8): three gaps of 2 ms; without the run's own span only the one between."""
    rows = [(1, 1, None, 0, 10), (1, 2, 1, 2, 4), (1, 3, 1, 6, 8), (2, 5, None, 2, 4), (2, 6, None, 6, 8)]
    df = spark.createDataFrame(rows, "trace long, span long, parent long, started long, ended long")
    got = sorted(tuple(r) for r in telemetry.uncovered(df).collect())
    assert got == [(1, 0, 2), (1, 4, 6), (1, 8, 10), (2, 4, 6)]


def test_admission(spark):
    row = "source string, commit_id string, committed_at long, kind string, entity_id long, content string"
    old = temporal.version_digests(spark.createDataFrame([("s", "c1", 1, "e", 1, "a"), ("s", "c1", 1, "e", 2, None), ("s", "c2", 5, "e", 1, "a")], row))
    new = temporal.version_digests(spark.createDataFrame([("s", "c1", 1, "e", 2, None), ("s", "c1", 1, "e", 1, "a"), ("s", "c2", 6, "e", 1, "b"), ("s", "c3", 9, "e", 1, "a")], row))
    got = {r["commit_id"]: (r["outcome"], r["reason"]) for r in temporal.admit(old, new).collect()}
    assert got["c1"] == ("repeated", None) and got["c3"] == ("stored", None) and got["c2"][0] == "refused"
    assert got["c2"][1].startswith("a different commit time; stored digest ")


def test_recorded_time_never_goes_back(spark):
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate([10, 5, 5, 20, 20])], "source string, seq long, clock long")
    assert [r["recorded"] for r in temporal.recorded_times(df, "source", "seq", "clock").orderBy("seq").collect()] == [10, 11, 12, 20, 21]


def test_positions_against_one_window(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(30), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x long, id long")
    got = {r["id"]: (r["position"], r["next_id"]) for r in temporal.positions(df, "g", [F.desc("x"), F.asc("id")], ["id"]).collect()}
    for g in ("a", "b", None):
        order = [i for _, _, i in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))]
        assert [got[i] for i in order] == list(zip(range(1, len(order) + 1), [*order[1:], None]))


def test_chains_and_cycles(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (20, 21), (21, 20), (22, 20)], "src long, dst long")
    assert {tuple(r) for r in graph.chains(edges).collect()} == {(5, 2, 3), (4, 2, 2), (3, 2, 1), (9, 8, 1)}
    assert {r["id"] for r in graph.on_cycles(edges).collect()} == {20, 21}
    assert [r["id"] for r in graph.first_cycle(edges).orderBy("place").collect()] == [20, 21, 20]
    assert graph.first_cycle(edges.where("src < 10")).count() == 0


@pytest.mark.parametrize("block", [1_000, 3])
def test_cochange_of_hubs(spark, block):
    rng = random.Random(5)
    pairs = {(rng.randrange(6), 100 + rng.randrange(25)) for _ in range(90)}
    df = spark.createDataFrame(sorted(pairs), "src long, dst long")
    for both in (False, True):
        near = {}
        for s, d in pairs | ({(d, s) for s, d in pairs} if both else set()):
            near.setdefault(d, set()).add(s)
        want = {(a, b): len(near[a] & near[b]) for a in near for b in near if a != b and len(near[a] & near[b]) >= 2}
        got = {(r["id"], r["other"]): r["n"] for r in graph.cochange(df, 50, both=both, block=block).collect()}
        assert got == want


def test_cochange_of_few_neighbours_meets_only_who_shares_two(spark):
    """A place that a hundred ids share, and of which only two share another, brings one pair together."""
    df = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 0), (2, 1)] + [(3 + i, i) for i in range(2, 100)], "near long, id long")
    assert graph._met(df.withColumns({"few": F.lit(True), "crowd": F.lit(100)}), ["near"], 1_000).count() == 0
    got = graph.cochange(df.select(F.col("near").alias("src"), F.col("id").alias("dst")), 5)
    assert {(r["id"], r["other"], r["n"], r["total"]) for r in got.collect()} == {(0, 1, 2, 2), (1, 0, 2, 2)}


@pytest.mark.parametrize("few", [0, 3, 64])
def test_cochange_of_few_and_many_neighbours(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(8)
    pairs = {(rng.randrange(12), 100 + min(rng.randrange(40), rng.randrange(40))) for _ in range(200)}
    near = {}
    for s, d in pairs:
        near.setdefault(d, set()).add(s)
    for least in (1, 2, 3):
        want = {(a, b): len(near[a] & near[b]) for a in near for b in near if a != b and len(near[a] & near[b]) >= least}
        got = {(r["id"], r["other"]): r["n"] for r in graph.cochange(spark.createDataFrame(sorted(pairs), "src long, dst long"), 50, least=least, block=4).collect()}
        assert got == want


@pytest.mark.parametrize("rows", [500_000, 2])
def test_chain_faults_across_ranges(spark, rows):
    """Chains that go back and forth between subjects and ranges, circles, and predecessors that don't exist."""
    rng = random.Random(3)
    prev = {i: rng.choice([None, i - 1 if i else None, i - 1 if i else None, rng.randrange(70), rng.randrange(60)]) for i in range(60)}
    led = set()
    while more := {i for i, p in prev.items() if i not in led and (p is None or p in led)}:
        led |= more
    want = {}
    for u in range(4):
        mine = [i for i in prev if i % 4 == u]
        n = max(sum(p == i for p in prev.values()) for i in mine)
        want[u] = (sum(prev[i] is None for i in mine), n, len(mine), sum(i not in led for i in mine))
    df = spark.createDataFrame([(i % 4, i, p) for i, p in prev.items()], "u long, id long, prev long")
    got = {r["u"]: (r["roots"], r["followers"], r["states"], r["unreached"]) for r in graph.chain_faults(df, "u", rows=rows).collect()}
    assert got == want
    assert graph.chain_faults(df.where("false"), "u").count() == 0


def test_dependency_rings_need_no_closure(spark, monkeypatch):
    """A ring of n files has n * n paths; rings are told apart by their components."""
    monkeypatch.setattr(graph, "closure", lambda edges: pytest.fail("the closure of a ring"))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, 7), (7, 6), (2, 6)], "src long, dst long")
    assert {(r["target"], r["detail"]) for r in rules.dependency_cycles(edges).collect()} == {("1", "1,2,3"), ("5", "5"), ("6", "6,7")}


def test_conditions_on_properties_join_nothing(spark):
    nodes = spark.createDataFrame([(1, "a", True), (2, "a", None), (3, "b", False), (4, None, True)], "id long, kind string, removed boolean")
    edges = spark.createDataFrame([("r", 1, 3), ("r", 1, 4), ("r", 2, 3)], "rel string, src long, dst long")
    kind, gone = {"property": ("kind", "_eq", "a")}, {"property": ("removed", "_eq", True)}
    found = quality.matching(nodes, edges, {"any": [{"all": [kind, {"not": gone}]}, {"all": [{"not": kind}, gone]}]})
    assert sorted(r["id"] for r in found.collect()) == [2, 4]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    two = {"neighbours": {"rel": "r", "side": "out", "atLeast": 2, "where": {"not": kind}}}
    ids = lambda c: sorted(r["id"] for r in quality.matching(nodes, edges, c).collect())
    assert ids(two) == [1] and ids({"not": two}) == [2, 3, 4] and ids({"any": [two, {"property": ("kind", "_eq", "b")}]}) == [1, 3]


def test_connection_of_a_null_parent(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), (1, 2)], "p long, c long")
    assert sorted(tuple(r) for r in connections.connection(df, "p", [F.asc("c")], 0).collect() if r["p"] is None) == [(None, 1, 2, 1)]


def test_search_line(spark):
    rows = [("a" * 40, " first line \nsecond"), ("label", ""), ("label", "label"), ("x", "word " * 30), ("b" * 40 + "\n", "v")]
    got = [r["l"] for r in spark.createDataFrame(rows, "label string, value string").select(identity.search_line(F.col("label"), F.col("value")).alias("l")).collect()]
    assert got == ["a" * 7 + " — first line", "label", "label", "x — " + ("word " * 18).strip() + "…", "b" * 40 + "\n — v"]


def test_view_scenarios(spark):
    """Collapse, context and inside one box: two calls between services are one relation to the neighbouring domain."""
    tree = [("shop", None), ("payments", None), ("web", "shop"), ("catalog", "shop"), ("cart", "web"), ("ui", "web"), ("api", "payments")]
    elements = spark.createDataFrame(tree, "id string, parent string")
    calls = spark.createDataFrame([("r1", "cart", "api"), ("r2", "ui", "api"), ("r3", "cart", "ui"), ("r4", "cart", "catalog")], "id string, src string, dst string")
    got = lambda *a, **k: {(r["from_id"], r["to_id"], r["n"]) for r in graph.view(elements, calls, *a, **k).collect()}
    assert got("shop", 1) == {("web", "catalog", 1)}
    assert got("shop", 1, context=True) == {("web", "catalog", 1), ("web", "payments", 2)}
    assert got("web", 1, context=True) == {("cart", "payments", 1), ("ui", "payments", 1), ("cart", "ui", 1), ("cart", "catalog", 1)}


def test_children_need_their_parent(spark):
    rows = [("s", "system", "payments", "x", 0, None, 0, None), ("s", "system", "api", "x", 0, None, 0, None)]
    held = spark.createDataFrame(rows, "source string, kind string, entity_id string, content string, valid_from long, valid_to long, recorded_from long, recorded_to long")
    parents = spark.createDataFrame([("api", "payments")], "entity_id string, parent string")
    assert [r["child"] for r in temporal.children_as_of(held, parents, 5, 5, "payments").collect()] == ["api"]
    with pytest.raises(ValueError, match="orders does not exist at 5"):
        temporal.children_as_of(held, parents, 5, 5, "orders")


def broadcasts(spark, run):
    """What ``run`` gives, and the names of its plans' nodes that send a table through the driver."""
    sc, store = spark.sparkContext._jsc.sc(), spark._jsparkSession.sharedState().statusStore()
    sc.listenerBus().waitUntilEmpty()
    before = store.executionsList().last().executionId() if store.executionsList().nonEmpty() else -1
    out = run()
    sc.listenerBus().waitUntilEmpty()
    after, names = store.executionsList(), []
    for i in range(after.size()):
        if (at := after.apply(i).executionId()) > before:
            nodes = store.planGraph(at).allNodes()
            names += [nodes.apply(k).name() for k in range(nodes.size())]
    assert any("Join" in n for n in names)
    return out, [n for n in names if n == "BroadcastExchange"]


def test_components_send_no_table_through_the_driver(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)] + [(7, 8), (8, 7), (8, 9), (7, 9), (9, 10), (0, 7)], "src long, dst long")
    found, sent = broadcasts(spark, lambda: as_set(cycles.components(edges)))
    assert found == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (7, 7), (8, 7), (9, 9), (10, 10)}
    assert not sent


def test_starved_stages_send_no_table_through_the_driver(spark):
    needs = spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "stage long, capability long")
    gives = spark.createDataFrame([(1, 11), (2, 12), (4, 12)], "stage long, capability long")
    found, sent = broadcasts(spark, lambda: as_set(graph.starved(needs, gives)))
    assert found == {(1, "10", 1), (2, "11>10", 2)}
    assert not sent
