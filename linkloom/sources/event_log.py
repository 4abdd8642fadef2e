"""The event log as a replayable source (S4, T2): ``spark.readStream.format("linkloom_events")``.

An offset is a place in the log: a file (files are ordered by time of writing,
then name) and a line in it. So a subscriber starts wherever it says, a late
one replays from the first event, and each has its own place in its own
checkpoint. The log is a folder of JSON-lines files that are written once
(``append_events``, or any Spark JSON writer).

Options: ``path``; ``start`` = ``first`` (default), ``last`` (only what comes
after the query began) or ``file:line``, the file's name and the number of its
lines to skip. Rows are the events' columns with ``log_file`` and ``log_line``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..schemas import CRAWL_EVENTS
from ..session import ship_package

SCHEMA = StructType([*CRAWL_EVENTS.fields, StructField("log_file", StringType()), StructField("log_line", LongType())])
#: Lines of a file that one task reads.
TASK_LINES = 200_000
NOWHERE = {"at": -1, "file": "", "line": 0}


def _system(path: str):
    """The file system of a path or uri, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str):
    """The file system of ``path`` and the log's files in order: (time of writing in ns, name, full path)."""
    from pyarrow import fs

    system, root = _system(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    named = [(f.mtime_ns or 0, f.path[len(root.rstrip("/")) + 1:], f.path) for f in found if f.is_file]
    return system, sorted(x for x in named if x[1].endswith((".json", ".jsonl")) and not any(p.startswith(("_", ".")) for p in x[1].split("/")))


def _lines(system, path: str) -> Iterator[bytes]:
    import io

    with system.open_input_stream(path) as raw:
        for line in io.BufferedReader(raw, 1 << 20):
            yield line.rstrip(b"\r\n")


@dataclass
class _Part(InputPartition):
    file: str
    full: str
    begin: int
    end: int | None


def _rows(path: str, part: _Part, fields) -> Iterator[tuple]:
    import datetime as dt

    system, _ = _system(path)
    for n, line in enumerate(_lines(system, part.full)):
        if part.end is not None and n >= part.end:
            return
        if n < part.begin or not line.strip():
            continue
        try:
            event = json.loads(line)
        except ValueError:
            continue  # a line that is no JSON is no event, as in the batch reader
        if not isinstance(event, dict):
            continue
        row = []
        for f in fields[:-2]:
            x, kind = event.get(f.name), f.dataType.simpleString()
            if x is not None and kind == "timestamp":
                x = dt.datetime.fromisoformat(x) if isinstance(x, str) else None
                x = x.replace(tzinfo=dt.timezone.utc) if x is not None and x.tzinfo is None else x
            elif x is not None:
                x = str(x) if kind == "string" else int(x) if isinstance(x, (int, float)) else None
            row.append(x)
        yield (*row, part.file, n)


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        return [_Part(name, full, 0, None) for _, name, full in _files(self.path)[1]]

    def read(self, partition) -> Iterator[tuple]:
        if partition is not None:  # an empty log has no partitions
            yield from _rows(self.path, partition, SCHEMA.fields)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, start: str):
        self.path, self.start = path, start
        self.counted: dict[str, int] = {}  # lines of files, which are written once

    def _count(self, system, full: str) -> int:
        if full not in self.counted:
            self.counted[full] = sum(1 for _ in _lines(system, full))
        return self.counted[full]

    def initialOffset(self) -> dict:
        if self.start == "first":
            return dict(NOWHERE)
        if self.start == "last":
            return self.latestOffset()
        name, _, line = self.start.rpartition(":")
        for at, file, _ in _files(self.path)[1]:
            if file == name:
                return {"at": at, "file": file, "line": int(line)}
        raise ValueError(f"no file {name!r} in the event log")

    def latestOffset(self) -> dict:
        system, files = _files(self.path)
        if not files:
            return dict(NOWHERE)
        at, name, full = files[-1]
        return {"at": at, "file": name, "line": self._count(system, full)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        system, files = _files(self.path)
        out = []
        for at, name, full in files:
            place = (at, name)
            if not (start["at"], start["file"]) <= place <= (end["at"], end["file"]):
                continue
            begin = start["line"] if place == (start["at"], start["file"]) else 0
            stop = end["line"] if place == (end["at"], end["file"]) else self._count(system, full)
            out += [_Part(name, full, a, min(a + TASK_LINES, stop)) for a in range(begin, stop, TASK_LINES)]
        return out

    def read(self, partition) -> Iterator[tuple]:
        yield from _rows(self.path, partition, SCHEMA.fields)

    def commit(self, end: dict) -> None:
        pass


class EventLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "linkloom_events"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"], self.options.get("start", "first"))


def event_log(spark: SparkSession, path: str, start: str = "first", stream: bool = True):
    """S4 as a stream from any place of the log, or (``stream=False``) all of it."""
    ship_package(spark)
    spark.dataSource.register(EventLog)
    if not stream:
        return spark.read.format("linkloom_events").option("path", path).load()
    return spark.readStream.format("linkloom_events").option("path", path).option("start", start).load()
