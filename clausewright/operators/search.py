"""Exact cosine top-k under a predicate."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.vectors import cosine
from ..sources.staging import shared_folder, staged
from .predicates import Where, compile_where

#: Questions, and bytes of their vectors, that are broadcast against all rows at a time; larger batches run in blocks of about so many.
QUESTIONS, QUESTION_BYTES = 10_000, 16 << 20
#: A block of more questions than this makes the rows' products dearer than moving the rows: they are dealt over all cores first, about so many to a file at most.
MANY, DEALT = 2_000, 100_000
#: Pairs of row and question whose scores a task sums anew at a time (a question's of one batch are taken together).
PAIRS = 32_768


def top_k_single(rows: DataFrame, vector: list[float], k: int = 5, where: Where | None = None, min_score: float | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The k best rows for one vector, ties to the smaller id; `min_score` filters what the top k leaves."""
    scored = rows.filter(compile_where(where)).withColumn("score", cosine(F.col(vector_col), F.array(*map(F.lit, map(float, vector)))))
    best = scored.filter("score is not null").orderBy(F.desc("score"), id_col).limit(k)
    return best if min_score is None else best.filter(F.col("score") >= min_score)


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of length 1, and which have a score: of `dim` components, all finite, not all zero."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dim))
    fits = np.flatnonzero(np.diff(ends) == dim)
    out[fits] = flat[ends[fits][:, None] + np.arange(dim)]
    norm = np.sqrt((out * out).sum(axis=1))
    valid = np.isfinite(norm) & (norm > 0)
    valid[np.diff(ends) != dim] = False
    out[valid] /= norm[valid, None]
    out[~valid] = 0
    return out, valid


def _meetings(batch: pa.RecordBatch, by_cell: dict[int, np.ndarray] | None, questions: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, questions) that are to be compared: all with all, or by the rows' cells (the column `cell`) the questions that look into them."""
    if by_cell is None:
        yield np.arange(batch.num_rows), np.arange(questions)
        return
    cells = batch.column(batch.schema.get_field_index("cell")).to_numpy()
    order = np.argsort(cells, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
        if len(rows) and (wanted := by_cell.get(int(cells[rows[0]]))) is not None:
            yield rows, wanted


def best_of_task(shared, k: int, others_only: bool, id_col: str, vector_col: str, columns: list[str]):
    """The rows of each batch that are among the k best of their question so far in the task: `columns` of the row, the question's columns and the score.

    `shared` is a broadcast (questions as a batch, their unit vectors, their ids, the questions of each cell or None).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, unit, ids, by_cell = shared.value
        kth = np.full(len(unit), -2.0)  # below any cosine
        of_id: dict = {}
        for j, i in enumerate(ids if others_only else []):
            if i is not None:
                of_id.setdefault(i, []).append(j)
        for batch in batches:
            own, valid = _units(batch.column(batch.schema.get_field_index(vector_col)), unit.shape[1])
            row_ids = batch.column(batch.schema.get_field_index(id_col))
            order = np.argsort(pc.rank(row_ids, tiebreaker="first").to_numpy(), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            same: dict[int, list[int]] = {}  # the rows that are the question's own
            for r, i in enumerate(row_ids.to_pylist() if of_id else []):
                for j in of_id.get(i, ()):
                    same.setdefault(j, []).append(r)
            chosen, of, scores = [], [], []
            for rows, wanted in _meetings(batch, by_cell, len(unit)):
                rows = rows[valid[rows]]
                if not len(rows):
                    continue
                mine, column = own[rows], np.full(batch.num_rows, -1)
                column[rows] = np.arange(len(rows))
                for first in range(0, len(wanted), 256):
                    who = wanted[first : first + 256]
                    lines = unit[who] @ mine.T
                    for i, j in enumerate(who.tolist() if same else []):
                        if j in same:
                            at = column[same[j]]
                            lines[i, at[at >= 0]] = -np.inf
                    least = kth[who]
                    if len(rows) > 4 * k and len(fresh := np.flatnonzero(least < -1.5)):  # the k best and what ties with them
                        least[fresh] = np.maximum(least[fresh], np.partition(lines[fresh], -k, axis=1)[:, -k])
                    fits = np.flatnonzero(lines >= (least - 1e-9)[:, None])
                    ends = np.searchsorted(fits, np.arange(len(who) + 1) * len(rows))
                    start = 0
                    while start < len(who):  # about PAIRS at a time
                        end = max(start + 1, int(np.searchsorted(ends, ends[start] + PAIRS, "right")) - 1)
                        i, at = np.divmod(fits[ends[start] : ends[end]], len(rows))
                        start = end
                        if not len(at):
                            continue
                        exact = (mine[at] * unit[who[i]]).sum(axis=1)  # in one order of summing for all rows, so equal rows tie
                        best = np.lexsort((place[rows[at]], -exact, i))
                        begins = np.searchsorted(i, i)  # i is sorted, so where each pair's question begins
                        nth = np.arange(len(i)) - begins
                        top = best[nth < k]
                        full = best[nth == k - 1]
                        kth[who[i[full]]] = np.maximum(kth[who[i[full]]], exact[full])
                        chosen.append(rows[at[top]])
                        of.append(who[i[top]])
                        scores.append(exact[top])
            if chosen:
                found = batch.select(columns).take(pa.array(np.concatenate(chosen)))
                questions = asked.take(pa.array(np.concatenate(of)))
                yield pa.RecordBatch.from_arrays([*found.columns, *questions.columns, pa.array(np.concatenate(scores))], [*found.schema.names, *questions.schema.names, "score"])

    return run


def question_blocks(questions: DataFrame, qid_col: str, qvector_col: str, most: int, carry_vectors: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list]]:
    """Blocks of at most about `most` questions and QUESTION_BYTES, by a hash of qid: what a question's hits carry, the unit vectors, the ids. Questions without a score go."""
    dim, total, held = questions.agg(F.max(F.size(qvector_col)), F.count(F.lit(1)), F.sum(F.size(qvector_col) * 8)).first()
    blocks = max(1, math.ceil(total / most), math.ceil((held or 0) / QUESTION_BYTES))
    for b in range(blocks if total and dim and dim > 0 else 0):
        own = questions.filter(F.pmod(F.xxhash64(qid_col), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        unit, valid = _units(own.column(qvector_col), dim)
        asked = own.filter(pa.array(valid)).combine_chunks()
        if asked.num_rows:
            batch = asked.to_batches()[0]
            carried = batch if carry_vectors else batch.select([c for c in batch.schema.names if c != qvector_col])
            yield carried, unit[valid], batch.column(batch.schema.get_field_index(qid_col)).to_pylist()


def ranked(found: DataFrame, k: int, qid_col: str, id_col: str) -> DataFrame:
    order = Window.partitionBy(qid_col).orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(rows: DataFrame, questions: DataFrame, k: int = 5, where: Where | None = None, min_score: float | None = None, others_only: bool = False, id_col: str = "id", vector_col: str = "embedding", qid_col: str = "qid", qvector_col: str = "qvector", carry_vectors: bool = True) -> DataFrame:
    """The k best rows by cosine for each question, with all columns of both, `score`, and `rank` from 1; ties to the smaller id.

    The questions are a stated set: they are broadcast in blocks of about QUESTION_BYTES and QUESTIONS, by a hash of qid, so a
    question is whole in one block. Each task keeps the k best of its rows by matrix products, and one exchange by question
    ranks what the tasks found. A block is done, and its broadcast gone, before the next one begins. Where questions are MANY,
    the rows are dealt over files of the shared folder once: a table may come in one row group, which one task reads. Vectors that are null or
    zero, hold a null or non-finite component, or have another length than the longest question's, take no part. `others_only`:
    a row is no hit of the question of its own id. Without `carry_vectors` the vectors of hits and questions stay behind, which
    spares the exchange most of its bytes.
    """
    spark, k = rows.sparkSession, k or 5
    kept = rows.filter(compile_where(where))
    columns = [c for c in kept.columns if carry_vectors or c != vector_col]
    of_question = [f for f in questions.schema.fields if carry_vectors or f.name != qvector_col]
    schema = StructType([*kept.select(*columns).schema.fields, *of_question, StructField("score", DoubleType())])
    passes, last = [], None
    folder, dealt = None, False
    for asked, unit, ids in question_blocks(questions, qid_col, qvector_col, QUESTIONS, carry_vectors):
        if len(unit) > MANY and not dealt:
            folder, dealt = folder or shared_folder(spark), True
            files = max(2 * spark.sparkContext.defaultParallelism, math.ceil(kept.count() / DEALT))
            kept = staged(kept.repartition(files), f"{folder}/rows")
        if last is not None:
            folder = folder or shared_folder(spark)
            passes.append(staged(last[0], f"{folder}/pass{len(passes)}"))
            last[1].destroy()
        shared = spark.sparkContext.broadcast((asked, unit, ids, None))
        best = kept.mapInArrow(best_of_task(shared, k, others_only, id_col, vector_col, columns), schema)
        last = ranked(best, k, qid_col, id_col), shared
    if last is not None and passes:
        passes.append(staged(last[0], f"{folder}/pass{len(passes)}"))
        last[1].destroy()
    elif last is not None:
        passes = [last[0]]
    found = reduce(DataFrame.unionByName, passes) if passes else ranked(spark.createDataFrame([], schema), k, qid_col, id_col)
    return found if min_score is None else found.filter(F.col("score") >= min_score)


def self_hits(rows: DataFrame, sample: int = 10, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """For the first `sample` rows by id: whether the nearest row to a row's own vector is itself."""
    own = rows.orderBy(id_col).limit(sample).select(F.col(id_col).alias("qid"), F.col(vector_col).alias("qvector"))
    found = top_k(rows, own, 1, id_col=id_col, vector_col=vector_col, carry_vectors=False)
    return found.select("qid", F.col(id_col).alias("nearest"), (F.col(id_col) == F.col("qid")).alias("is_self"))


def hit_projection(hits: DataFrame) -> DataFrame:
    """Hits as a client gets them: text columns, missing ones empty, the first page as `page`, the score to 4 places."""
    names = ("article_no", "standard", "standard_name", "version", "status", "force_status", "chapter", "kind", "text")
    plain = [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in hits.columns else F.lit("")).alias(c) for c in names]
    page = F.coalesce(F.col("page_start").cast("string"), F.lit("")) if "page_start" in hits.columns else F.lit("")
    return hits.select(*[c for c in ("qid", "rank") if c in hits.columns], *plain, page.alias("page"), F.round("score", 4).alias("score"))
