"""Embeddings kept by the content they were made of, so that only texts that are new are encoded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Encoder = Callable[[], Callable[[list[str]], list[list[float]]]]


class EmbeddingCache:
    """A table of the catalog: (digest, model, embedding), partitioned by model; the digest is the SHA-256 of a text."""

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (digest STRING, embedding ARRAY<DOUBLE>, model STRING) USING parquet PARTITIONED BY (model)")

    def _known(self, model: str) -> DataFrame:
        return self.spark.table(self.table).filter(F.col("model") == model).select("digest", "embedding")

    def embed(self, rows: DataFrame, encoder: Encoder, model: str, text_col: str = "text", vector_col: str = "embedding") -> DataFrame:
        """`rows` with `vector_col`. Texts that the table lacks for this model are encoded once each, however often they come, and appended; a null text counts as empty.

        `encoder()` loads the encoder, once for each task; it takes texts batch by batch. Rows that two runs appended at the
        same time count once.
        """
        digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
        texts = rows.select(digest.alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["digest"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            to_vectors = None
            for batch in batches:
                if batch.num_rows:
                    to_vectors = to_vectors or encoder()
                    made = pa.array(to_vectors(batch.column(1).to_pylist()), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([batch.column(0), made], ["digest", "embedding"])

        missing = texts.join(self._known(model), "digest", "left_anti").mapInArrow(run, "digest string, embedding array<double>")
        missing.withColumn("model", F.lit(model)).write.mode("append").insertInto(self.table)
        known = self._known(model).dropDuplicates(["digest"]).withColumnsRenamed({"digest": "_digest", "embedding": vector_col})
        return rows.drop(vector_col).join(known, digest == F.col("_digest")).drop("_digest")
