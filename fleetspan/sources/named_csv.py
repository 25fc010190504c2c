"""A Spark data source for CSV trees whose files agree on column names, but maybe not on their order, and whose rows may be too short or too long."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file that a task reads; rows of an Arrow batch.
SPLIT_BYTES, BATCH_ROWS = 8 << 20, 4096
#: The fault of a row with more or fewer fields than its file's header.
RAGGED = "column_count"


def opened(path: str):
    """(file system, path in it) of a local path or of a URI that pyarrow's file systems know."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


@dataclass
class Split(InputPartition):
    file: str
    begin: int
    end: int


class Lines:
    """Lines of a file as text; `at` is the byte where the next one begins."""

    def __init__(self, file, at: int, end: int):
        self.file, self.at, self.end = file, at, end

    def __iter__(self) -> Iterator[str]:
        while line := self.file.readline():
            self.at += len(line)
            yield line.decode("utf-8", "replace")


class NamedCsvReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.glob = options["path"], options.get("glob", "*.csv")
        self.required = json.loads(options.get("required", "[]"))
        self.columns = json.loads(options["columns"]) if "columns" in options else None
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.files = json.loads(options["files"]) if "files" in options else None

    def partitions(self) -> list[Split]:
        from pyarrow import fs

        system, root = opened(self.root)
        wanted = [f"{root}/{f}" for f in self.files] if self.files is not None else fs.FileSelector(root, recursive=True)
        out = []
        for info in system.get_file_info(wanted):
            if info.type == fs.FileType.NotFound:
                raise ValueError(f"{info.path} isn't there.")
            if info.type == fs.FileType.File and fnmatch(info.base_name, self.glob) and info.base_name[0] not in "._":
                step = self.split_bytes or max(info.size, 1)
                out += [Split(info.path[len(root) :].lstrip("/"), at, min(at + step, info.size)) for at in range(0, max(info.size, 1), step)]
        return out or [Split("", 0, 0)]

    def header(self, file, name: str) -> tuple[list[str], int]:
        """A file's column names, and where its rows begin."""
        lines = Lines(file, 0, 0)
        names = [c.removeprefix("﻿").strip() for c in next(csv.reader(lines), [])]
        if lacking := [c for c in [*self.required, *(self.columns or [])] if c not in names]:
            raise ValueError(f"{name}: lacks {', '.join(dict.fromkeys(lacking))}")
        if not names or len(set(names)) < len(names):
            raise ValueError(f"{name}: a column comes twice" if names else f"{name}: has no header")
        return names, lines.at

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.file:
            return
        system, root = opened(self.root)
        with system.open_input_file(f"{root}/{split.file}") as raw, io.BufferedReader(raw, 1 << 20) as file:
            names, first = self.header(file, split.file)
            at = max(split.begin, first)
            file.seek(at if at == first else at - 1)
            if at > first:  # the line that is being read here belongs to the split before
                at += len(file.readline()) - 1
            yield from self.batches(split, names, Lines(file, at, split.end))

    def batches(self, split: Split, names: list[str], lines: Lines) -> Iterator[pa.RecordBatch]:
        rows, places, n, whole = [], [], 0, not self.split_bytes
        reader = csv.reader(iter(lines))
        while lines.at < lines.end:
            at = lines.at
            row = next(reader, None)
            if row is None:
                break
            if row:  # an empty line is no row
                n += 1
                rows.append(row)
                places.append(n if whole else at)
            if len(rows) == BATCH_ROWS:
                yield self.batch(split, names, rows, places)
                rows, places = [], []
        if rows:
            yield self.batch(split, names, rows, places)

    def batch(self, split: Split, names: list[str], rows: list[list[str]], places: list[int]) -> pa.RecordBatch:
        n = len(names)
        fault = pa.array([None if len(r) == n else RAGGED for r in rows], pa.string())
        if self.columns is None:
            data = [pa.array([list(zip(names, r)) for r in rows], pa.map_(pa.string(), pa.string()))]
            own = ["data"]
        else:
            at = [names.index(c) for c in self.columns]
            data = [pa.array([r[i] if i < len(r) else None for r in rows], pa.string()) for i in at]
            own = self.columns
        file = pa.array([split.file] * len(rows), pa.string())
        return pa.RecordBatch.from_arrays([*data, file, pa.array(places, pa.int64()), fault], names=[*own, "source_file", "at", "fault"])


class NamedCsv(DataSource):
    """Format "named_csv". Options: path, a folder that is searched to all depths; glob of file names; columns (a JSON list) to give as strings of those names, else all go into a map `data`;
    required (a JSON list), columns that each file must have; files (a JSON list), paths below the folder, in place of a search; splitbytes, 0 to read files whole.

    Fields go by the names in each file's own header, which every task reads for itself, so nothing is scanned twice. `source_file` is the path below the folder, `at` the byte at which a row begins,
    or its number from 1 where files are read whole; `fault` is "column_count" for a row of another length than its header, whose missing fields are null. Only files read whole may have line breaks
    inside quotes. Empty lines are no rows, a byte order mark is skipped, bytes that aren't UTF-8 become U+FFFD; a file without a header, without a required column or with one that comes twice ends the read.
    """

    @classmethod
    def name(cls) -> str:
        return "named_csv"

    def schema(self) -> str:
        columns = json.loads(self.options["columns"]) if "columns" in self.options else None
        own = "data map<string,string>" if columns is None else ", ".join(f"`{c}` string" for c in columns)
        return f"{own}, source_file string, at long, fault string"

    def reader(self, schema) -> NamedCsvReader:
        return NamedCsvReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedCsv)
