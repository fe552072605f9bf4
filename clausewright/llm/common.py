"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes in their columns, that a count may confirm before a table is broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Bytes of text that a numpy kernel takes at a time (a longer document is taken alone).
SLICE_BYTES = 1 << 20
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared folder that the cluster names, else below the context's own checkpoint folder; where there is neither, a local one on a local master, as in tests, and RuntimeError on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        base = "/tmp/clausewright-scratch"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str) -> DataFrame:
    """Cuts lineage: writes `df` as a table in the shared folder and reads it back."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """Marks a side of a join on equal keys, which then is not broadcast. Spark knows a table by the size of its files: arrays and ids that repeat, and rows made of arrays, can take a hundred times that in the driver."""
    return df.hint("merge")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks `df` for broadcast if it is counted to have no more than `rows` rows and BROADCAST_BYTES; else the join shuffles."""
    text = [F.octet_length(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c, t in df.dtypes if t in ("string", "binary") or t.startswith("array")]
    size = sum(text, F.lit(8 * len(df.columns))).cast("long")
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= BROADCAST_BYTES else shuffled(df)


def share_of_hashes(*columns: str, share: float) -> Column:
    """Whether a row's hash of `columns` is among the smallest `share` of all hashes: a bound on a sample that holds at any size of table."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1) < F.lit(min(int(share * 2**63), 2**63 - 1))


def unused(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores behind as make it no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Returns what a task has freed to the system: its worker lives on, for tasks of other kinds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64 (wraps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _offsets(texts: pa.Array) -> np.ndarray:
    if not len(texts):
        return np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def row_slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(first row, number of rows) of slices of about `limit` bytes of an Arrow string column."""
    at, row = _offsets(texts), 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, end - row
        row = end


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Cuts an Arrow string column into slices of about `limit` bytes: (first row, bytes, offsets). Nulls count as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    at, data = _offsets(texts), texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    for row, n in row_slices(texts, limit):
        yield row, data[at[row] : at[row + n]], at[row : row + n + 1] - at[row]


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, add: int = 0) -> DataFrame:
    """(id, v array<bigint>): floor(scale * x) + add of each component as double. Null and empty vectors, and such as hold a null or non-finite component, go; rows without an id stay."""
    x = F.col(vector_col)
    valid = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.filter(valid).select(F.col(id_col).alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale) + F.lit(add)).alias("v"))


def whole_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of `dim` long integers each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dim)
