"""Spark data sources for matrix files and archives, read in parts by the executors.

`npy_matrix` reads a .npy file as cells, a partition for each range of its rows: the
header tells where a row begins, so no task holds more than a part of the file.
Conditions on `col_id` and `row_id` are pushed down: rows outside are not read, and
columns that are not asked for are not made into cells.  `zip_lines` reads the members
of an archive as lines, one member a partition, as a stream.

Files are opened through Arrow's file systems (local paths, hdfs, s3, gs); see
`reachable` for paths that only Spark's own readers can open.
"""

from __future__ import annotations

import ast
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Bytes of a file that one partition reads, and that a task holds at a time.
PART_BYTES, STEP_BYTES = 1 << 25, 1 << 22


def opened(path: str):
    """The file at a path or address, to be read at any place."""
    if "://" in path or path.startswith("file:"):
        system, at = fs.FileSystem.from_uri(path)
    else:
        system, at = fs.LocalFileSystem(), path
    return system.open_input_file(at)


def reachable(path: str) -> bool:
    """Whether Arrow can open the path; if not, only Spark's readers may."""
    try:
        opened(path).close()
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


@dataclass
class Header:
    """Where the numbers of a .npy file begin, and how they lie."""

    begin: int
    kind: np.dtype
    rows: int
    columns: int
    by_column: bool

    @classmethod
    def of(cls, file) -> Header:
        if file.read(6) != b"\x93NUMPY":
            raise ValueError("not a .npy file")
        major = file.read(2)[0]
        n = int.from_bytes(file.read(2 if major == 1 else 4), "little")
        told = ast.literal_eval(file.read(n).decode("latin-1" if major < 3 else "utf-8"))
        kind = np.dtype(told["descr"])
        if kind.kind not in "biuf" or len(told["shape"]) != 2:
            raise ValueError("a matrix has two dimensions of numbers")
        return cls(8 + (2 if major == 1 else 4) + n, kind, *told["shape"], told["fortran_order"])


@dataclass
class Lines(InputPartition):
    """Rows (of a file by columns: columns) begin to end - 1."""

    begin: int
    end: int


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, columns: list[int] | None):
        self.path = path
        with opened(path) as f:
            self.header = Header.of(f)
        self.columns = None if columns is None else set(columns)
        self.rows = (0, self.header.rows)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Takes conditions on row_id and col_id, and gives back the others."""
        for x in filters:
            name, value = x.attribute if hasattr(x, "attribute") else (), getattr(x, "value", None)
            low, high = self.rows
            if name == ("col_id",) and isinstance(x, EqualTo | In):
                wanted = {value} if isinstance(x, EqualTo) else set(value)
                self.columns = wanted if self.columns is None else self.columns & wanted
            elif name == ("row_id",) and isinstance(x, EqualTo):
                self.rows = (max(low, value), min(high, value + 1))
            elif name == ("row_id",) and isinstance(x, GreaterThan | GreaterThanOrEqual):
                self.rows = (max(low, value + isinstance(x, GreaterThan)), high)
            elif name == ("row_id",) and isinstance(x, LessThan | LessThanOrEqual):
                self.rows = (low, min(high, value + isinstance(x, LessThanOrEqual)))
            else:
                yield x

    def partitions(self) -> list[InputPartition]:
        h = self.header
        begin, end = (0, h.columns) if h.by_column else self.rows
        each = max(1, PART_BYTES // max(1, (h.rows if h.by_column else h.columns) * h.kind.itemsize))
        return [Lines(k, min(k + each, end)) for k in range(begin, end, each)]

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        h = self.header
        length = h.rows if h.by_column else h.columns
        wanted = None if self.columns is None else np.array(sorted(c for c in self.columns if 0 <= c < h.columns), np.int64)
        step = max(1, STEP_BYTES // max(1, length * h.kind.itemsize))
        with opened(self.path) as f:
            for begin in range(partition.begin, partition.end, step):
                lines = np.arange(begin, min(begin + step, partition.end))
                if h.by_column and wanted is not None and not np.isin(lines, wanted).any():
                    continue
                f.seek(h.begin + begin * length * h.kind.itemsize)
                x = np.frombuffer(f.read(len(lines) * length * h.kind.itemsize), h.kind).reshape(len(lines), length).astype(float)
                rows, cols = (np.arange(h.rows), lines) if h.by_column else (lines, np.arange(h.columns))
                x = x.T if h.by_column else x
                keep = (rows >= self.rows[0]) & (rows < self.rows[1])
                some = slice(None) if wanted is None else np.isin(cols, wanted)
                x, rows, cols = x[keep][:, some], rows[keep], cols[some]
                v = np.ascontiguousarray(x).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, len(cols))), pa.array(np.tile(cols, len(rows))), pa.array(np.where(np.isfinite(v), v, np.nan), from_pandas=True)], names=["row_id", "col_id", "value"])


class MatrixFile(DataSource):
    """Option `path`; `columns`, numbers with commas between them, are the only ones read."""

    @classmethod
    def name(cls) -> str:
        return "npy_matrix"

    def schema(self) -> str:
        return "row_id long, col_id long, value double"

    def reader(self, schema) -> DataSourceReader:
        columns = self.options.get("columns")
        return MatrixReader(self.options["path"], [int(c) for c in columns.split(",")] if columns else None)


@dataclass
class Member(InputPartition):
    name: str


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, members: list[str] | None):
        self.path, self.members = path, members

    def partitions(self) -> list[InputPartition]:
        return [Member(name) for name, _ in members(self.path) if self.members is None or name in self.members]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        with opened(self.path) as f, zipfile.ZipFile(f) as archive, archive.open(partition.name) as raw:
            at = 0
            text = io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline=None)
            while lines := text.readlines(STEP_BYTES):
                lines = [x.removesuffix("\n") for x in lines]
                yield pa.RecordBatch.from_arrays([pa.array([partition.name] * len(lines)), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines)], names=["member", "line", "value"])
                at += len(lines)


class Archive(DataSource):
    """Option `path`; `members`, names with line ends between them, are the only ones read."""

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return "member string, line long, value string"

    def reader(self, schema) -> DataSourceReader:
        names = self.options.get("members")
        return ArchiveReader(self.options["path"], names.split("\n") if names else None)


def members(path: str) -> list[tuple[str, int]]:
    """Names and sizes of an archive's files, from its directory."""
    with opened(path) as f, zipfile.ZipFile(f) as archive:
        return [(x.filename, x.file_size) for x in archive.infolist() if not x.is_dir()]


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session, and lets it push conditions down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (MatrixFile, Archive):
        spark.dataSource.register(source)
