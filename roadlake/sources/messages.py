"""Message files as a source: lines of JSON by channel, read as a batch or as a stream that resumes where it stopped.

A channel is a file of a folder, to which lines are only added. An offset holds the bytes of every file that have been read, always up to a
line's end: a line that is still being written waits. A stream that stops resumes from the offsets of its checkpoint, without loss or repeats.
Lines that are no JSON object are rows too, with ok = false, so that they can be counted; messages() leaves them out and reports how many there were.
"""

from __future__ import annotations

import fnmatch
import io
import json
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from roadlake.functions.scalars import freshness

FORMAT, SCHEMA = "roadlake_messages", "channel string, position long, payload string, ok boolean"
#: Bytes of a file that one task reads.
PIECE = 64 << 20


def _system(path: str):
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def _sizes(path: str, pattern: str) -> dict[str, int]:
    """The bytes of each channel's file."""
    system, root = _system(path)
    found = system.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
    return {f.base_name: f.size for f in found if f.is_file and f.base_name[:1] not in "._" and fnmatch.fnmatchcase(f.base_name, pattern)}


def _last_line_end(path: str, name: str, start: int, end: int) -> int:
    """Where the last whole line before `end` ends; `start` if there is none."""
    system, root = _system(path)
    with system.open_input_file(f"{root}/{name}") as f:
        while end > start:
            a = max(start, end - (1 << 16))
            f.seek(a)
            at = f.read(end - a).rfind(b"\n")
            if at >= 0:
                return a + at + 1
            end = a
    return start


class Piece(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


def _pieces(start: dict[str, int], end: dict[str, int]) -> list[Piece]:
    out = []
    for name in sorted(end):
        for a in range(start.get(name, 0), end[name], PIECE):
            out.append(Piece(name, a, min(a + PIECE, end[name])))
    return out


def _lines(path: str, piece: Piece) -> Iterator[tuple]:
    """The lines that begin in a piece."""
    system, root = _system(path)
    with io.BufferedReader(system.open_input_file(f"{root}/{piece.name}"), 1 << 20) as f:
        at = piece.start
        if at:
            f.seek(at - 1)
            if f.read(1) != b"\n":  # inside a line, which is the piece's before
                at += len(f.readline())
        f.seek(at)
        while at < piece.end:
            line = f.readline()
            if not line:
                return
            text = line.decode("utf-8", "replace").strip()
            if text:
                try:
                    ok = isinstance(json.loads(text), dict)
                except ValueError:
                    ok = False
                yield piece.name, at, text, ok
            at += len(line)


class _Batch(DataSourceReader):
    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def partitions(self) -> list[Piece]:
        return _pieces({}, _sizes(self.path, self.pattern)) or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[tuple]:
        return _lines(self.path, piece) if piece.name else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self.last = path, pattern, {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        ends = {n: _last_line_end(self.path, n, self.last.get(n, 0), size) for n, size in _sizes(self.path, self.pattern).items()}
        self.last = {**self.last, **{n: e for n, e in ends.items() if e}}
        return {"files": dict(sorted(self.last.items()))}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.last = {**end["files"], **{n: max(e, self.last.get(n, 0)) for n, e in self.last.items()}}
        return _pieces(start["files"], end["files"])

    def read(self, piece: Piece) -> Iterator[tuple]:
        return _lines(self.path, piece)

    def commit(self, end: dict) -> None:
        pass


class MessageSource(DataSource):
    """Options: path, a folder; pattern, of the names of channels (all)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(self.options["path"], self.options.get("pattern", "*"))

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options["path"], self.options.get("pattern", "*"))


def messages(spark: SparkSession, path: str, pattern: str = "*", stream: bool = False) -> DataFrame:
    """channel, position and payload of the messages of a folder. What is no JSON is left out and counted by the observed metric
    "messages" (of a stream, in each progress report): all and bad."""
    spark.dataSource.register(MessageSource)
    reader = (spark.readStream if stream else spark.read).format(FORMAT).option("path", path).option("pattern", pattern)
    seen = reader.load().observe("messages", F.count("*").alias("all"), F.count_if(~F.col("ok")).alias("bad"))
    return seen.where("ok").drop("ok")


def with_freshness(states: DataFrame, now: int, fresh: int = 30, aging: int = 90) -> DataFrame:
    """Stored states with their age and freshness at the time of reading, whatever they said when they were written. states: observed (epoch seconds)."""
    age = F.lit(now) - F.col("observed")
    return states.withColumn("freshness_seconds", F.greatest(F.lit(0), age)).withColumn("freshness_status", freshness(age, fresh, aging))
