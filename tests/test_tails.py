"""Sources that seek: ranges, tails and lines appended while a stream runs."""

import json
import os

import pytest

from tessera.sources import tails


def test_byte_ranges(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é1é2é3".encode())
    (tmp_path / "b.bin").write_bytes(b"ab\0cd")
    (tmp_path / "c.bin").write_bytes(b"ab\xff\xfe")
    (tmp_path / "d.txt").write_bytes(b"")
    (tmp_path / ".hidden").write_bytes(b"x")
    name = lambda rows: {os.path.basename(r["path"]): (r["size"], r["start"], r["text"], r["binary"]) for r in rows.collect()}
    assert name(tails.byte_range(spark, str(tmp_path))) == {"a.txt": (9, 0, "é1é2é3", False), "b.bin": (5, 0, None, True), "c.bin": (4, 0, None, True), "d.txt": (0, 0, "", False)}
    # characters that the range cuts are left out
    assert name(tails.byte_range(spark, str(tmp_path / "a.txt"), 1, 6)) == {"a.txt": (9, 1, "1é2", False)}
    assert name(tails.byte_range(spark, f"file://{tmp_path}/a.txt", 3, 2)) == {"a.txt": (9, 3, "é", False)}
    assert name(tails.byte_range(spark, str(tmp_path / "a.txt"), 50, 2)) == {"a.txt": (9, 9, "", False)}


def test_tail_reads_only_the_end(spark, tmp_path):
    with open(tmp_path / "large.log", "wb") as f:
        f.seek(1 << 33)  # eight gigabytes of nothing, which nobody reads
        f.write(b"half\nlast but one\nlast\n")
    (tmp_path / "small.log").write_bytes(b"one\n\ntwo")
    got = {(os.path.basename(r["path"]), r["n"], r["line"], r["truncated"]) for r in tails.tail(spark, str(tmp_path), 21).collect()}
    assert got == {("large.log", 1, "last but one", True), ("large.log", 2, "last", True), ("small.log", 0, "one", False), ("small.log", 2, "two", False)}


def span(i):
    return json.dumps({"traceId": "t", "spanId": f"s{i}", "name": "n", "startTimeUnixNano": str(i * 10**6), "endTimeUnixNano": str(i * 10**6 + 5 * 10**5), "attributes": {}})


def test_half_a_line_waits(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    start = lambda: (
        tails.trace_stream(spark, str(folder)).writeStream.option("checkpointLocation", str(tmp_path / "state"))
        .foreachBatch(lambda df, _: seen.extend(r["spanId"] for r in df.collect())).start()
    )
    query = start()

    def step(expected):
        query.processAllAvailable()
        got = sorted(seen)
        seen.clear()
        assert got == expected

    (folder / "a.jsonl").write_text(span(1) + "\n" + span(2)[:30])
    step(["s1"])
    with open(folder / "a.jsonl", "a") as f:
        f.write(span(2)[30:])
    step([])
    with open(folder / "a.jsonl", "a") as f:
        f.write("\n" + span(3) + "\n")
    (folder / "b.jsonl").write_text(span(4) + "\n")
    step(["s2", "s3", "s4"])
    (folder / "b.jsonl").write_text("")  # shorter: read anew
    step([])
    with open(folder / "b.jsonl", "a") as f:
        f.write(span(5) + "\n")
    step(["s5"])
    (folder / "new").write_text(span(6) + "\n" + span(7) + "\n")
    os.replace(folder / "new", folder / "a.jsonl")  # another file of the same name
    step(["s6", "s7"])
    query.stop()
    with open(folder / "a.jsonl", "a") as f:
        f.write(span(8) + "\n")
    query = start()  # goes on where it stopped
    step(["s8"])
    with open(folder / "a.jsonl", "a") as f:
        f.write("no span\n")
    with pytest.raises(Exception):
        query.processAllAvailable()
    query.stop()


def test_lines_are_read_once_by_any_pieces(tmp_path, monkeypatch):
    lines = [("x" * (i % 7)) + str(i) for i in range(200)]
    (tmp_path / "f").write_text("\n".join(lines) + "\nunfinished")
    for size in (1, 3, 10, 64, 10_000):
        monkeypatch.setattr(tails, "PIECE", size)
        reader = tails._LineReader(str(tmp_path))
        end = reader.latestOffset()
        got = [r[2] for p in reader.partitions({}, end) for r in reader.read(p)]
        assert got == lines
        middle = {k: [w, len("\n".join(lines[:50])) + 1] for k, (w, _) in end.items()}
        assert [r[2] for p in reader.partitions(middle, end) for r in reader.read(p)] == lines[50:]
