"""Quality scores of whole texts: statistics of each document, scored by boosted trees fitted on labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .boosted_trees import Trees, fit
from .common import share_of_hashes, text_slices
from .shingles import NOT_ALNUM, word_hashes

#: About so many labelled rows are fitted on; with more, those of the smallest hashes of the id.
FIT_ROWS = 50_000
_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".", b",;:", b"!", b"?", b"'\"()-"]
_KIND = np.full(256, len(_KINDS), np.int64)  # what is left of ASCII: symbols
_KIND[128:] = len(_KINDS) + 1
for _i, _chars in enumerate(_KINDS):
    _KIND[list(_chars)] = _i
_N = len(_KINDS) + 2
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
#: Of each text: shares of its bytes by kind, then what `statistics` lists.
WIDTH = _N + 9


def _distinct(hashes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: how many hashes are distinct, and how often the commonest comes."""
    n = len(start) - 1
    of = np.repeat(np.arange(n), np.diff(start))
    order = np.lexsort((hashes, of))
    h, d = hashes[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
    most = np.zeros(n)
    np.maximum.at(most, d[first], np.diff(np.append(first, len(h))))
    return np.bincount(d[first], minlength=n).astype(float), most


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each text: shares of byte kinds; log of bytes; words per byte; shares of distinct words, of the commonest word, of distinct word triples, of distinct lines; log of lines; words per full stop; share of bytes in words of one kind of letter case. All zero for an empty text."""
    n = len(at) - 1
    size = np.diff(at).astype(float)
    of = np.repeat(np.arange(n), np.diff(at))
    kind = _KIND[data]
    counts = np.bincount(of * _N + kind, minlength=n * _N).reshape(n, _N).astype(float)
    per = np.maximum(size, 1)
    words, ws = word_hashes(data, at, NOT_ALNUM)
    lines, ls = word_hashes(data, at, _NEWLINE)
    n_words, n_lines = np.diff(ws).astype(float), np.diff(ls).astype(float)
    different, most = _distinct(words, ws)
    three = words[:-2] * np.uint64(0x9E3779B97F4A7C15) + words[1:-1] * np.uint64(0xD6E8FEB86659FD93) + words[2:] if len(words) > 2 else np.zeros(0, np.uint64)
    inside = np.repeat(ws[1:], np.diff(ws))[: len(three)] - np.arange(len(three)) >= 3
    triples, kept = three[inside], np.concatenate([[0], np.cumsum(inside)]) if len(three) else np.zeros(1, np.int64)
    ts = kept[np.minimum(ws, len(kept) - 1)]
    d3, _ = _distinct(triples, ts)
    dl, _ = _distinct(lines, ls)
    pairs = np.bincount(of[1:][(kind[1:] == 1) & (kind[:-1] == 1) & (of[1:] == of[:-1])], minlength=n) if len(data) > 1 else np.zeros(n)
    more = [np.log1p(size), n_words / per, different / np.maximum(n_words, 1), most / np.maximum(n_words, 1), d3 / np.maximum(np.diff(ts), 1), dl / np.maximum(n_lines, 1), np.log1p(n_lines), n_words / (1 + counts[:, 5]), pairs / per]
    return np.column_stack([counts / per[:, None], *more])


def _column_statistics(texts: pa.Array) -> np.ndarray:
    made = [statistics(data, at) for _, data, at in text_slices(texts)]
    return np.concatenate(made) if made else np.zeros((0, WIDTH))


def _measurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _column_statistics(batch.column(2))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["_id", "y", "x"])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees fitted on the labelled rows of `docs` that are not held out.

    Labels other than 0 and 1, and ids whose labels disagree, tell nothing. About `fit_rows` labelled rows at most are
    measured and brought to the driver as WIDTH numbers each: beyond it, those with the smallest hashes of the id. Of rows
    that repeat an id, the one with the least statistics counts.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id"))
    known = known.agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("_top")).filter("y = _top").select("_id", "y")
    known = known.filter(~held_out("_id"))
    total = known.count()
    if total > fit_rows:
        known = known.filter(share_of_hashes("_id", share=fit_rows / total))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    near = F.broadcast(known) if min(total, fit_rows) <= FIT_ROWS else known
    measured = rows.join(near, "_id").select("_id", "y", "text").mapInArrow(_measurer, "_id long, y int, x array<double>")
    measured = measured.groupBy("_id").agg(F.min(F.struct("x", "y")).alias("m")).select("m.y", "m.x").toPandas()
    x = np.stack(measured["x"].to_numpy()) if len(measured) else np.zeros((0, WIDTH))
    y = measured["y"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # sums do not depend on the order in which tasks ended
    return fit(x[order], y[order])


def score_quality(docs: DataFrame, trees: Trees, score_col: str = "score", text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs` and the score of each whole text (null and empty ones have that of all-zero statistics). A column named `score_col` is replaced."""
    base = docs.drop(score_col)
    where = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _column_statistics(batch.column(where).cast(pa.string()))
            scores = np.concatenate([trees.score(x[i : i + 4096]) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, score_col])

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField(score_col, DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", **how) -> DataFrame:
    """A row for each row of `docs`: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold)."""
    trees = fit_quality(docs, labels, id_col=id_col, **how)
    text_col = how.get("text_col", "text")
    scored = score_quality(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), trees)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
