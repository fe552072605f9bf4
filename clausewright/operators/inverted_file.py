"""Approximate cosine top-k on an inverted file: vectors lie in a table partitioned by the cell of their nearest coarse centroid.

A question looks into the cells nearest to it; the cells that a block of questions wants are a filter on the partition column,
so the other partitions are not read. How many cells a question looks into is measured when the index is built: the fewest
for which a sample of rows finds the wanted share of its true neighbours. Where a predicate leaves a question fewer than k
hits, it looks into twice as many cells, and so on to all of them: few hits are never for want of looking.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..sources.staging import staged
from . import search
from .predicates import Where, compile_where

#: Cells at most; rows for each cell on which the centroids are fitted; rows with which the cells to look into are measured.
CELLS, FIT_ROWS, MEASURED = 4096, 256, 400
#: What is added to the wanted recall when it is measured, for the error of the sample.
MARGIN = 0.02
#: Questions times cells that the driver orders at a time.
ORDERED = 1 << 22


def _share(n: int, of: int, *columns: str):
    """Whether a row's hash is among the smallest n / of."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1) < F.lit(min(2**63 - 1, n * 2**63 // max(1, of)))


def _scored(rows: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector has a score: finite components, not all of them 0."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return rows.filter(x.isNotNull() & finite & F.exists(x, lambda e: e != 0))


def _to_cells(shared, vector_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            unit, _ = search._units(batch.column(batch.schema.get_field_index(vector_col)), centres.shape[1])
            cell = np.concatenate([(unit[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(unit), 4096)]) if len(unit) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    return run


@dataclass(frozen=True)
class InvertedFile:
    """An index in a folder that all executors share: `rows`, partitioned by cell, `cells` and `settings`."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(rows: DataFrame, path: str, cells: int | None = None, recall: float = 0.95, k: int = 10, id_col: str = "id", vector_col: str = "embedding", seed: int = 11) -> InvertedFile:
        """Indexes every row whose vector has a score (see top_k(); of the most frequent length), with all its columns.

        `cells` is by default the root of the number of rows, CELLS at most; `recall` of the `k` nearest is measured on about
        MEASURED rows. The centroids are fitted on about FIT_ROWS rows a cell, or all if there are fewer; they are k-means
        centroids by cosine. A folder that holds an index is written anew. Rows with a column `cell` are refused (ValueError).
        """
        if "cell" in (c.lower() for c in rows.columns):
            raise ValueError("the rows have a column cell")
        spark, x = rows.sparkSession, F.col(vector_col)
        scored = _scored(rows, vector_col)
        per = scored.groupBy(F.size(vector_col).alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
        dim, n = (per["dim"], per["n"]) if per else (0, 0)
        scored = scored.filter(F.size(vector_col) == dim)
        wanted = min(CELLS, cells or max(1, math.isqrt(n)))
        if n:
            fit = scored.filter(_share(FIT_ROWS * wanted, n, id_col, vector_col)).select(array_to_vector(x.cast("array<double>")).alias("features")).cache()
            model = KMeans(k=wanted, maxIter=10, seed=seed, initMode="random", distanceMeasure="cosine").fit(fit) if wanted > 1 and fit.count() > wanted else None
            fit.unpersist()
            centres = np.stack(model.clusterCenters()) if model else np.ones((1, dim)) / math.sqrt(dim)
            centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
        else:
            centres = np.zeros((0, dim))
        table = [(i, c.tolist()) for i, c in enumerate(centres)]
        spark.createDataFrame(table, "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/cells")
        out = InvertedFile(spark, path)
        out._place(scored, centres, vector_col, "overwrite")
        out._set(len(centres), dim, k, recall, rows.schema)
        if len(centres) > 1:
            out._set(out._measured(centres, n, recall, k, id_col, vector_col), dim, k, recall, rows.schema)
        return out

    def add(self, rows: DataFrame, vector_col: str = "embedding") -> None:
        """Appends rows of the same columns to the cells of their nearest centroids, which stay as they are. Vectors without a score, or of another length, go."""
        if rows.schema.simpleString() != self.rows().drop("cell").schema.simpleString():
            raise ValueError("the rows have other columns than the index")
        centres = self.centres()
        if not len(centres):
            raise ValueError("the index was built without a vector")
        self._place(_scored(rows, vector_col).filter(F.size(vector_col) == self.settings()["dim"]), centres, vector_col, "append")

    def _place(self, scored: DataFrame, centres: np.ndarray, vector_col: str, mode: str) -> None:
        schema = StructType([*scored.schema.fields, StructField("cell", IntegerType())])
        shared = self.spark.sparkContext.broadcast(centres)
        placed = scored.mapInArrow(_to_cells(shared, vector_col), schema) if len(centres) else self.spark.createDataFrame([], schema)
        placed.hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(f"{self.path}/rows")  # large cells over several tasks
        shared.destroy()

    def _set(self, probes: int, dim: int, k: int, recall: float, schema: StructType) -> None:
        one = self.spark.createDataFrame([(probes, dim, k, recall, schema.json())], "probes int, dim int, k int, recall double, schema string")
        one.write.mode("overwrite").parquet(f"{self.path}/settings")

    def settings(self) -> dict:
        return self.spark.read.parquet(f"{self.path}/settings").first().asDict()

    def centres(self) -> np.ndarray:
        found = sorted((r["cell"], r["centre"]) for r in self.spark.read.parquet(f"{self.path}/cells").collect())  # CELLS rows at most
        return np.array([c for _, c in found]) if found else np.zeros((0, 0))

    def rows(self) -> DataFrame:
        schema = StructType([*StructType.fromJson(json.loads(self.settings()["schema"])).fields, StructField("cell", IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def _measured(self, centres: np.ndarray, n: int, recall: float, k: int, id_col: str, vector_col: str) -> int:
        """The fewest cells that hold `recall` of the k nearest of a sample of rows, other than themselves."""
        sample = self.rows().filter(_share(MEASURED, n, id_col, vector_col)).select(F.col(id_col).alias("_q"), F.col(vector_col).alias("_v"))
        near = search.top_k(self.rows().select(id_col, vector_col, "cell"), sample, k, others_only=True, id_col=id_col, vector_col=vector_col, qid_col="_q", qvector_col="_v", carry_vectors=False)
        found = near.groupBy("_q").agg(F.collect_list("cell").alias("cells")).join(sample, "_q").select("_v", "cells").collect()  # about MEASURED rows
        if not found:
            return len(centres)
        unit = np.array([r["_v"] for r in found])
        order = np.argsort(-(unit @ centres.T), axis=1, kind="stable")
        rank = np.empty_like(order)
        rank[np.arange(len(order))[:, None], order] = np.arange(len(centres))
        needed = np.sort(np.concatenate([rank[i, r["cells"]] for i, r in enumerate(found)])) + 1
        return int(needed[min(len(needed) - 1, math.ceil(min(1.0, recall + MARGIN) * len(needed)) - 1)])

    def candidates(self, cells: list[int], where: Where | None = None) -> DataFrame:
        """The rows of some cells under a predicate: the cells are a filter on partitions."""
        return self.rows().filter(F.col("cell").isin(cells)).filter(compile_where(where))

    def search(self, questions: DataFrame, folder: str, k: int = 5, where: Where | None = None, min_score: float | None = None, others_only: bool = False, probes: int | None = None, id_col: str = "id", vector_col: str = "embedding", qid_col: str = "qid", qvector_col: str = "qvector") -> DataFrame:
        """What top_k() returns without vectors, approximately: a question looks into `probes` cells (as measured, if not given), and into more while it has fewer than k hits. `folder`: a new one that all executors share, for what each round finds."""
        spark, settings, centres = self.spark, self.settings(), self.centres()
        rows = self.rows()
        columns = [c for c in rows.columns if c not in (vector_col, "cell")]
        of_question = [*[f for f in questions.schema.fields if f.name != qvector_col], StructField("_question", IntegerType())]
        schema = StructType([*rows.select(*columns).schema.fields, *of_question, StructField("score", DoubleType())])
        rounds = []
        most = max(1, min(search.QUESTIONS, ORDERED // max(1, len(centres))))
        for asked, unit, ids in search.question_blocks(questions, qid_col, qvector_col, most, False) if len(centres) else ():
            if unit.shape[1] != settings["dim"]:
                continue
            asked = asked.append_column("_question", pa.array(np.arange(len(unit), dtype=np.int32)))
            order = np.argsort(-(unit @ centres.T), axis=1, kind="stable")
            still, first, last, block = np.arange(len(unit)), 0, min(len(centres), probes or settings["probes"]), []
            while True:
                cells = order[still, first:last]
                flat, who = cells.ravel(), np.repeat(still, cells.shape[1])
                by = np.argsort(flat, kind="stable")
                starts = np.flatnonzero(np.diff(flat[by], prepend=-1))
                by_cell = dict(zip(flat[by][starts].tolist(), np.split(who[by], starts[1:]), strict=True))
                shared = spark.sparkContext.broadcast((asked, unit, ids, by_cell))
                found = self.candidates(sorted(by_cell), where).mapInArrow(search.best_of_task(shared, k, others_only, id_col, vector_col, columns), schema)
                block.append(staged(search.ranked(found, k, qid_col, id_col).drop("rank"), f"{folder}/round{len(rounds)}"))
                rounds.append(block[-1])
                shared.destroy()
                if last == len(centres):
                    break
                counts = reduce(DataFrame.unionByName, block).groupBy("_question").count().filter(F.col("count") >= k).select("_question").collect()  # a block's questions at most
                still = np.setdiff1d(still, [r["_question"] for r in counts])
                if not len(still):
                    break
                first, last = last, min(len(centres), 2 * last)
        found = reduce(DataFrame.unionByName, rounds) if rounds else spark.createDataFrame([], schema)
        out = search.ranked(found.drop("_question"), k, qid_col, id_col)
        return out if min_score is None else out.filter(F.col("score") >= min_score)
