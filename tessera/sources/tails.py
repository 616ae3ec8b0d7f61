"""Data sources that seek: byte ranges and ends of files, and lines that are appended to files while a stream runs.

Paths may be local or any address that Arrow's file systems open. Only the bytes asked for are read.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.sources.files import SPAN, spans_of

#: Bytes of a file that one task reads.
PIECE = 32 << 20


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder by name; hidden ones are left out."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))
    info = system.get_file_info(inner)
    found = system.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.Directory else [info]
    head = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
    return sorted((head + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


class _Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int = 0):
        self.path, self.start, self.end, self.size = path, start, end, size


def _decoded(data: bytes, cut: bool) -> str | None:
    """The text of a range, or null if it is binary: bytes that aren't UTF-8, or a zero byte. A character that the range cuts
    at its start or end is left out (``cut``)."""
    if cut:
        while data and data[0] & 0xC0 == 0x80:
            data = data[1:]
        for back in range(1, min(4, len(data)) + 1):
            if data[-back] & 0xC0 != 0x80:
                need = 4 if data[-back] >= 0xF0 else 3 if data[-back] >= 0xE0 else 2 if data[-back] >= 0xC0 else 1
                data = data[:-back] if need > back else data
                break
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if "\0" in text else text


class ByteRanges(DataSource):
    """Format ``byterange``, a row a file: (path, size, start, text, binary). Options: ``path``; ``start`` and ``length`` of the range,
    or ``last``, so many bytes before the end."""

    @classmethod
    def name(cls) -> str:
        return "byterange"

    def schema(self) -> str:
        return "path string, size long, start long, text string, binary boolean"

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options)


class _RangeReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.first, self.length, self.last = options["path"], int(options.get("start", 0)), options.get("length"), options.get("last")

    def partitions(self) -> list[_Piece]:
        out = []
        for path, size in _files(self.path):
            start = max(size - int(self.last), 0) if self.last is not None else min(self.first, size)
            out.append(_Piece(path, start, size if self.length is None else min(start + int(self.length), size), size))
        return out

    def read(self, piece: _Piece) -> Iterator[tuple]:
        with _open(piece.path) as f:
            f.seek(piece.start)
            data = f.read(piece.end - piece.start)
        text = _decoded(data, piece.start > 0 or piece.end < piece.size)
        yield piece.path, piece.size, piece.start, text, text is None


def byte_range(spark: SparkSession, path: str, start: int = 0, length: int | None = None, last: int | None = None) -> DataFrame:
    """(path, size, start, text, binary) of the same byte range of one file or of all files of a folder."""
    spark.dataSource.register(ByteRanges)
    asked = {"path": path, "start": start} | ({"length": length} if length is not None else {}) | ({"last": last} if last is not None else {})
    return spark.read.format("byterange").options(**{k: str(v) for k, v in asked.items()}).load()


def tail(spark: SparkSession, path: str, most: int = 2 << 20) -> DataFrame:
    """(path, n, line, truncated): the lines in each file's last ``most`` bytes; a first line that the cut halves is dropped.

    ``most`` bytes of each file are read, whatever its size. Binary files have no lines.
    """
    rows = byte_range(spark, path, last=most).where("NOT binary").withColumn("truncated", F.col("start") > 0)
    lines = rows.select("path", "truncated", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where((~F.col("truncated") | (F.col("n") > 0)) & (F.col("line") != "")).select("path", "n", "line", "truncated")


class AppendedLines(DataSource):
    """Streaming format ``appendedlines``: (path, at, line) of the lines that are ended by a line break, as files grow.

    The offset holds of every file how far it has been read, and which file it was: a tail without its line break waits for it, a
    file that has been replaced or has become shorter is read anew, and a new file from its beginning.
    """

    @classmethod
    def name(cls) -> str:
        return "appendedlines"

    def schema(self) -> str:
        return "path string, at long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LineReader(self.options["path"])


class _LineReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: [self._which(path), self._ended(path, size)] for path, size in _files(self.path)}

    @staticmethod
    def _which(path: str) -> int:
        return os.stat(path).st_ino if "://" not in path else 0

    @staticmethod
    def _ended(path: str, size: int) -> int:
        """The end of the last whole line, looked for from the end."""
        with _open(path) as f:
            at = size
            while at:
                start = max(at - (1 << 16), 0)
                f.seek(start)
                if (found := f.read(at - start).rfind(b"\n")) >= 0:
                    return start + found + 1
                at = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[_Piece]:
        out = []
        for path, (which, upto) in sorted(end.items()):
            before, at = start.get(path, (which, 0))
            at = at if before == which and at <= upto else 0
            out += [_Piece(path, i, min(i + PIECE, upto), at) for i in range(at, upto, PIECE)]
        return out

    def read(self, piece: _Piece) -> Iterator[tuple]:
        """Lines that begin in the piece; the last one may end beyond it. ``size`` is where the range itself began."""
        with io.BufferedReader(_open(piece.path), 1 << 16) as f:
            at = piece.start
            f.seek(max(at - 1, 0))
            if at > piece.size:  # a line belongs to the piece in which it begins
                at = at - 1 + len(f.readline())
            f.seek(at)
            while at < piece.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    return
                if line.strip():
                    yield piece.path, at, line[:-1].decode("utf-8")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


def appended_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (path, at, line) of the files of a folder (``AppendedLines``)."""
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format("appendedlines").option("path", path).load()


def trace_stream(spark: SparkSession, path: str) -> DataFrame:
    """Spans of JSON lines as they are appended; a line that is no span fails the read, as in ``files.traces``."""
    rows = appended_lines(spark, path).select(F.from_json("line", SPAN, {"mode": "FAILFAST"}).alias("s"))
    return spans_of(rows.select("s.*"))
