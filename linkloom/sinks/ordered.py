"""Exports as one document in ordered pieces (K2, K3, K5): ``df.write.format("linkloom_document")``.

Each task writes its piece under a hidden name; the commit adds what stands
before, between and after the pieces and only then gives them their names. The
export is a folder whose files, put end to end in name order, are one JSON
array or one CSV file with one header: no task and no driver ever holds or
copies it whole. Nothing shows until the commit, and a write that fails
removes what it wrote.

``open_export`` reads a committed export as one stream, ``save_export`` copies
it to one local file (for a reader that wants a single file; it streams).
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship_package

FORMATS = ("json", "csv")


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _Piece(WriterCommitMessage):
    partition: int
    file: str
    rows: int


def _encoded(kind: str, batch, raw: set[str]) -> Iterator[bytes]:
    """The rows of a batch; ``raw`` columns hold JSON text, and are left out where it is null."""
    rows = batch.to_pylist()
    if kind == "csv":
        out = io.StringIO(newline="")
        writer = csv.writer(out)
        for r in rows:
            writer.writerow(["" if v is None else v for v in r.values()])
            yield out.getvalue().encode()
            out.seek(0)
            out.truncate()
    for r in rows if kind == "json" else ():
        parts = [f"{json.dumps(k, ensure_ascii=False)}: {v if k in raw else json.dumps(v, ensure_ascii=False)}" for k, v in r.items() if not (k in raw and v is None)]
        yield ("{" + ", ".join(parts) + "}").encode()


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, columns: list[str], raw: set[str], overwrite: bool):
        self.path, self.kind, self.columns, self.raw, self.overwrite = path.rstrip("/"), kind, columns, raw, overwrite
        self.held = f"{self.path}.writing-{uuid.uuid4().hex}"  # a hidden sibling until the commit

    def write(self, iterator) -> WriterCommitMessage:
        context = TaskContext.get()
        system, held = _system(self.held)
        file = f"piece-{context.partitionId():06d}-{context.taskAttemptId()}"
        rows = 0
        system.create_dir(held, recursive=True)
        with system.open_output_stream(f"{held}/{file}") as out:
            for batch in iterator:
                for row in _encoded(self.kind, batch, self.raw):
                    out.write(b",\n" + row if rows and self.kind == "json" else row)
                    rows += 1
        return _Piece(context.partitionId(), file, rows)

    def commit(self, messages: list) -> None:
        system, held = _system(self.held)
        _, path = _system(self.path)
        system.create_dir(held, recursive=True)
        if self.kind == "csv":
            head = io.StringIO(newline="")
            csv.writer(head).writerow(self.columns)
            between, before, after = b"", head.getvalue().encode(), b""
        else:
            between, before, after = b",\n", b"[\n", b"\n]\n"
        kept = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        used = {m.file for m in kept}
        from pyarrow import fs

        for f in system.get_file_info(fs.FileSelector(held)):
            if f.base_name not in used:  # empty pieces, and those of attempts that were lost
                system.delete_file(f.path)

        def put(name: str, text: bytes) -> None:
            if text:
                with system.open_output_stream(f"{held}/{name}") as out:
                    out.write(text)

        put("000000-begin", before)
        for n, m in enumerate(kept):
            system.move(f"{held}/{m.file}", f"{held}/{n + 1:06d}-b-rows")
            if n:
                put(f"{n + 1:06d}-a-next", between)
        put("999999-end", after)
        if system.get_file_info(path).type != fs.FileType.NotFound:
            if not self.overwrite:
                raise FileExistsError(path)
            old = system.get_file_info(path)
            system.delete_dir(path) if old.type == fs.FileType.Directory else system.delete_file(path)
        system.move(held, path)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, held = _system(self.held)
        if system.get_file_info(held).type != fs.FileType.NotFound:
            system.delete_dir(held)


class Document(DataSource):
    @classmethod
    def name(cls) -> str:
        return "linkloom_document"

    def writer(self, schema: StructType, overwrite: bool):
        kind = self.options.get("kind", "json")
        if kind not in FORMATS:
            raise ValueError(f"kind must be one of {', '.join(FORMATS)}")
        raw = set(filter(None, self.options.get("raw", "").split(",")))
        return _Writer(self.options["path"], kind, [f.name for f in schema.fields], raw, overwrite)


def write_document(rows: DataFrame, path: str, kind: str, order: list, raw: tuple[str, ...] = (), overwrite: bool = False) -> None:
    """``rows`` in the order of ``order`` (columns that are not written) as one document at ``path``.

    An existing path needs ``overwrite`` and is refused before anything is
    written. ``raw``: columns that hold JSON text (left out of a row where null).
    """
    from pyarrow import fs

    system, at = _system(path)
    if not overwrite and system.get_file_info(at).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    spark = rows.sparkSession
    ship_package(spark)
    spark.dataSource.register(Document)
    ordered = rows.orderBy(*order).drop(*order)
    ordered.write.format("linkloom_document").mode("overwrite" if overwrite else "append").option("path", path).option("kind", kind).option("raw", ",".join(raw)).save()


def open_export(path: str) -> io.BufferedIOBase:
    """A committed export as one binary stream."""
    from pyarrow import fs

    system, at = _system(path)
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.is_file)

    class _Joined(io.RawIOBase):
        def __init__(self):
            self.rest, self.now = list(files), None

        def readable(self) -> bool:
            return True

        def readinto(self, buffer) -> int:
            while True:
                if self.now is None:
                    if not self.rest:
                        return 0
                    self.now = system.open_input_stream(self.rest.pop(0))
                got = self.now.read(len(buffer))
                if got:
                    buffer[:len(got)] = got
                    return len(got)
                self.now.close()
                self.now = None

    return io.BufferedReader(_Joined(), 1 << 20)


def save_export(path: str, target: str) -> None:
    """A committed export as one local file, copied in blocks; ``target`` shows when it is whole."""
    import os
    import shutil

    part = f"{target}.part-{uuid.uuid4().hex}"
    try:
        with open_export(path) as src, open(part, "wb") as out:
            shutil.copyfileobj(src, out, 1 << 20)
        os.replace(part, target)
    finally:
        if os.path.exists(part):
            os.remove(part)
