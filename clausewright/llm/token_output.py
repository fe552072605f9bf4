"""Tokenizes documents, writes their ids in a range-coded file format in id order, and reads it back.

The folder is a Parquet table whose rows are segments of `rans`: (part, segment, start, n_docs, n_tokens, data). Part p holds
ids below those of part p + 1; `start` counts the ids of earlier segments of the same part. Spark's commit protocol writes it,
so it may lie in any store that Spark writes to, and a lost task leaves nothing half-written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, row_slices, scratch
from .rans import decode_segment, encode_segment
from .tokenize import CACHE_WORDS, TokenEncoder

#: Ids that share one frequency table; a longer document is a segment of its own.
SEGMENT_IDS = 1 << 21
#: Bytes of text that are encoded at a time.
TEXT_BYTES = 1 << 20
#: The place of rows without an id.
NULL_ID = -(1 << 63)
FILE_SCHEMA = "part int, segment int, start long, n_docs long, n_tokens long, data binary"


def _tokenizer(path: str, end_id: int, bounds: list[int], words: int, text_bytes: int):
    # An id that is several bounds is dealt over the parts behind the first of them, by the CRC-32 of its rows' ids.
    values, repeats = np.unique(np.array(bounds, np.int64), return_counts=True)

    def parts_of(doc_ids: np.ndarray, sums: np.ndarray) -> np.ndarray:
        first = np.searchsorted(bounds, doc_ids, "left")
        if not len(values):
            return first
        at = np.minimum(np.searchsorted(values, doc_ids), len(values) - 1)
        own = np.where(values[at] == doc_ids, repeats[at], 0)
        return first + np.where(own > 1, 1 + (sums * own >> 32), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenEncoder(path, words)
        wide = np.dtype("<u2" if max(tokens.size, end_id + 1) <= 1 << 16 else "<u4")
        for batch in batches:
            for row, n in row_slices(batch.column(1), text_bytes):
                ids = batch.column(0).slice(row, n)
                flat, sizes = tokens.encode(batch.column(1).slice(row, n))
                ends = np.cumsum(sizes)
                flat = np.insert(flat, ends, end_id).astype(wide)
                at = np.concatenate([[0], ends + np.arange(1, n + 1)]) * wide.itemsize
                if at[-1] >= 1 << 31:
                    raise ValueError("a text has ids of over 2 GB, which is no value of a Spark row")
                raw = memoryview(flat.tobytes())
                sums = np.array([zlib.crc32(raw[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
                parts = parts_of(ids.fill_null(NULL_ID).to_numpy(), sums).astype(np.int32)
                lists = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(parts), ids, pa.array(np.full(n, wide.itemsize, np.int32)), lists, pa.array(sums)], ["part", "doc_id", "width", "ids", "sum"])
        del tokens
        give_back()

    return run


def _coder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int | None, np.ndarray]] = []
    size = start = segment = 0
    part = None

    def flush() -> pa.RecordBatch:
        nonlocal size, start, segment
        ids = np.concatenate([x for _, x in held])
        data = encode_segment(ids, np.array([len(x) for _, x in held]), np.array([d or 0 for d, _ in held], np.int64), np.array([d is None for d, _ in held]))
        out = pa.RecordBatch.from_pylist([{"part": part, "segment": segment, "start": start, "n_docs": len(held), "n_tokens": len(ids), "data": data}], schema=pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())]))
        start, segment, size = start + len(ids), segment + 1, 0
        held.clear()
        return out

    for batch in batches:
        raw = batch.column(3)
        for i, (p, d, w) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
            ids = np.frombuffer(raw[i].as_buffer(), f"<u{w}")
            if held and (p != part or size + len(ids) > SEGMENT_IDS):
                yield flush()
            if p != part:
                part, start, segment = p, 0, 0
            held.append((d, ids.astype(np.uint32)))
            size += len(ids)
    if held:
        yield flush()
    give_back()


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, start, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            ids, sizes, doc_ids, nulls = decode_segment(data)
            ends = np.cumsum(sizes)
            raw = memoryview(ids.astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), part, np.int32)), pa.array(doc_ids, mask=nulls), pa.array(start + ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", words: int = CACHE_WORDS, text_bytes: int = TEXT_BYTES) -> None:
    """Writes the ids of every whole text, each text's followed by `end_id`, in ascending order of `id_col`.

    Null texts count as empty: they have the end id alone. Rows without an id come first; rows of one id, or of none, follow
    each other by the CRC-32 of their ids, then by the ids, and all are kept: an id with more rows than a part takes several
    parts. Other columns take no part. An empty table gives an empty folder that reads as no rows. A text of more than 2 GB of
    ids fails. The tokenizer file is opened on the executors. `words` that a task's cache holds and `text_bytes` that are
    encoded at a time trade memory (about 150 bytes a word) for time, and change no id.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = F.coalesce("doc_id", F.lit(NULL_ID))
    cut = source.select(F.percentile_approx(placed, [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    bounds = sorted(cut or [])
    tokens = source.mapInArrow(_tokenizer(tokenizer, end_id, bounds, words, text_bytes), "part int, doc_id long, width int, ids binary, sum long")
    ordered = tokens.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("doc_id", "sum", "ids")
    ordered.select("part", "doc_id", "width", "ids").mapInArrow(_coder, FILE_SCHEMA).write.mode("overwrite").option("compression", "uncompressed").parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Decodes the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers). A damaged file fails."""
    files = spark.read.schema(FILE_SCHEMA).parquet(folder)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each part of the folder
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = files.select("part", "start", "data").mapInArrow(_reader, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, folder: str | None = None, **how) -> DataFrame:
    """Writes `docs` and returns what the files hold; see write_tokens() and read_tokens()."""
    folder = folder or f"{scratch(docs.sparkSession)}/tokens"
    write_tokens(docs, folder, tokenizer, **how)
    return read_tokens(docs.sparkSession, folder)
