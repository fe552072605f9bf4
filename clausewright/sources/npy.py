"""A data source for matrices in numpy's format, read by ranges of rows.

A file's header tells its shape, so a range of rows is a range of bytes: a matrix of any size is read by many tasks, and
neither its shape nor its positions need a pass over it. Paths are local to all executors or such as pyarrow's file systems
open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a matrix that one task reads, and rows that it hands on at a time.
RANGE_BYTES, BATCH_ROWS = 64 << 20, 4096


class ManifestError(RuntimeError):
    """A manifest or a matrix that cannot be read."""


@dataclass(frozen=True)
class Matrix:
    """A file's header; `first` is the position of its first row over all files."""

    path: str
    first: int
    rows: int
    dim: int
    kind: str
    by_column: bool
    offset: int


@dataclass
class Rows(InputPartition):
    matrix: Matrix
    at: int
    count: int


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else path.replace(":", "://", 1))


def headers(path: str) -> list[Matrix]:
    """The headers of a matrix file, or of those of a folder in the order of their names; none where there is no file."""
    system, place = _system(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.Directory:
        found = sorted(f.path for f in system.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File and f.base_name[0] not in "._")
    else:
        found = [place] if info.type == fs.FileType.File else []
    out, first = [], 0
    for name in found:
        with system.open_input_file(name) as f:
            try:
                version = np.lib.format.read_magic(f)
                shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            except ValueError as e:
                raise ManifestError(f"{name} has no header of a matrix") from e
            if len(shape) != 2:
                raise ManifestError(f"{name} has {len(shape)} dimensions, not 2")
            if kind.kind not in "fiu":
                raise ManifestError(f"{name} holds no plain numbers")
            if f.size() < f.tell() + shape[0] * shape[1] * kind.itemsize:
                raise ManifestError(f"{name} is cut off")
            out.append(Matrix(name, first, shape[0], shape[1], kind.str, by_column, f.tell()))
        first += shape[0]
    return out


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Rows]:
        out = []
        for m in headers(self.path):
            step = max(1, self.range_bytes // max(1, m.dim * np.dtype(m.kind).itemsize))
            out += [Rows(m, at, min(step, m.rows - at)) for at in range(0, m.rows, step)]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        m = partition.matrix
        kind, system = np.dtype(m.kind), _system(self.path)[0]
        with system.open_input_file(m.path) as f:
            for at in range(partition.at, partition.at + partition.count, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.at + partition.count - at)
                if m.by_column:
                    part = np.stack([np.frombuffer(f.read_at(n * kind.itemsize, m.offset + (c * m.rows + at) * kind.itemsize), kind) for c in range(m.dim)], axis=1) if m.dim else np.zeros((n, 0))
                else:
                    part = np.frombuffer(f.read_at(n * m.dim * kind.itemsize, m.offset + at * m.dim * kind.itemsize), kind).reshape(n, m.dim)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m.dim), pa.array(np.ascontiguousarray(part, np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(m.first + at, m.first + at + n)), lists], ["pos", "embedding"])


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return "pos long, embedding array<float>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatrixSource)
