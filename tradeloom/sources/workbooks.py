"""XLSX files as a data source of their own: ``spark.read.format("xlsx")`` and ``spark.readStream.format("xlsx")``.

    workbooks.register(spark)
    spark.read.format("xlsx").load("/folder")                              # cells
    spark.read.format("xlsx").option("table", "sheets").load("/folder")    # sheets, and a code for files that can't be read
    spark.read.format("xlsx").option("table", "all").load("/folder")       # both from one opening: (document_id, cell, sheet)

A folder is listed with all below it; files are dealt to tasks by size, and a file is one task's unit, opened in the task through its
file system, so that only the parts a reader asks for are fetched.  An empty folder has no rows; a file that is gone when its task
comes counts as one that can't be read.  Any file system of pyarrow will do; for others there is ``xlsx.files``.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tradeloom.sources import xlsx

#: Bytes of files that a task reads, about.
TASK_BYTES = 64 << 20
#: Seconds for which a file must have stood unchanged before a stream takes it: several files may carry the same time.
SETTLED = 2.0

_NAMES = {table: [c.split()[0] for c in columns.split(", ")] for table, columns in (("cells", xlsx.CELLS), ("sheets", xlsx.SHEETS))}
_STRUCTS = {table: "struct<" + ", ".join(c.replace(" ", ": ", 1) for c in columns.split(", ")[1:]) + ">" for table, columns in (("cells", xlsx.CELLS), ("sheets", xlsx.SHEETS))}
SCHEMAS = {"cells": xlsx.CELLS, "sheets": xlsx.SHEETS, "all": f"document_id string, cell {_STRUCTS['cells']}, sheet {_STRUCTS['sheets']}"}


@dataclass(frozen=True)
class Found:
    path: str
    size: int
    changed: int  # nanoseconds


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def listed(folder: str) -> list[Found]:
    """The XLSX files at or below a path, oldest first."""
    system, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    head = folder[: len(folder) - len(path)] if folder.endswith(path) else ""
    at = system.get_file_info(path)
    if at.type == fs.FileType.NotFound:
        raise FileNotFoundError(folder)
    infos = [at] if at.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
    found = [Found(head + i.path, i.size or 0, i.mtime_ns or 0) for i in infos if i.is_file and i.path.lower().endswith(".xlsx")]
    return sorted(found, key=lambda f: (f.changed, f.path))


def dealt(files: list[Found], most: int = TASK_BYTES) -> list[Files]:
    """Files in runs of about so many bytes; a larger file has a task of its own."""
    out: list[list[str]] = []
    room = 0
    for f in files:
        if not out or f.size > room:
            out.append([])
            room = most
        out[-1].append(f.path)
        room -= f.size
    return [Files(paths) for paths in out]


def rows(part: Files, table: str) -> Iterator[tuple]:
    """The rows of a task's files, each opened once."""
    cell, sheet = Row(*_NAMES["cells"][1:]), Row(*_NAMES["sheets"][1:])
    for path in part.paths:
        own: list[tuple] = []
        try:
            system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
            with system.open_input_file(inner) as source:
                for s, cells in xlsx.workbook(source):
                    if table != "cells":
                        values = [s.get(c) for c in _NAMES["sheets"][1:]]
                        own.append((path, *values) if table == "sheets" else (path, None, sheet(*values)))
                    for c in cells if table != "sheets" else ():
                        values = [{**s, **c}[name] for name in _NAMES["cells"][1:]]
                        own.append((path, *values) if table == "cells" else (path, cell(*values), None))
        except xlsx.UNREADABLE:
            values = [None] * (len(_NAMES["sheets"]) - 2) + ["FILE_CORRUPTED"]
            own = [] if table == "cells" else [(path, *values) if table == "sheets" else (path, None, sheet(*values))]
        yield from own  # a file counts whole or not at all


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def partitions(self) -> list[Files]:
        return dealt(listed(self.path)) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows(partition, self.table)


class StreamReader(DataSourceStreamReader):
    """An offset is the time and path of the last file taken, so it stays small however many files there are.

    A file that comes later with an older time than that is not seen: move files in under their time of arrival.  A file that is
    changed counts as a new one.
    """

    def __init__(self, path: str, table: str, settled: float):
        self.path, self.table, self.settled = path, table, settled

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        before = (time.time() - self.settled) * 1e9
        old = [f for f in listed(self.path) if f.changed <= before]
        return {"changed": old[-1].changed, "path": old[-1].path} if old else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["changed"], start["path"]), (end["changed"], end["path"])
        return dealt([f for f in listed(self.path) if low < (f.changed, f.path) <= high])

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows(partition, self.table)


class Workbooks(DataSource):
    """Options: path; table (cells, sheets or all; cells if not given); settled (seconds, of streams)."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _options(self) -> tuple[str, str]:
        path, table = self.options.get("path"), self.options.get("table", "cells")
        if not path:
            raise ValueError("xlsx: a path is needed")
        if table not in SCHEMAS:
            raise ValueError(f"xlsx: table is {table!r}, not one of {', '.join(SCHEMAS)}")
        return path, table

    def schema(self) -> str:
        return SCHEMAS[self._options()[1]]

    def reader(self, schema: StructType) -> Reader:
        return Reader(*self._options())

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(*self._options(), float(self.options.get("settled", SETTLED)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Workbooks)
