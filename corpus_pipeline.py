"""The corpus pipeline: five stages over `documents`, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.common import scratch, small, stage, table, unused
from clausewright.llm.decontaminate import decontaminate
from clausewright.llm.near_dedup import near_duplicates
from clausewright.llm.quality import fit_quality, score_quality
from clausewright.llm.queries import mix, tokenizer_path
from clausewright.llm.token_output import token_output

KEEP_SCORE = 0.7


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at KEEP_SCORE or more, empty ones by the score of empty texts; all rows are judged apart."""
    score = unused(docs, "_quality_score")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), score)
    return scored.filter(F.col(score) >= KEEP_SCORE).drop(score)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id.

    Rows that repeat an id with one text count as one document: one of them stays; with other texts they share the id's fate.
    Rows without an id are in no group, but of those of one text one stays too.
    """
    folder = scratch(spark)
    gone_id, again_id = unused(docs, "_gone"), unused(docs, "_again")
    judged = stage(near_duplicates(docs, words=5, percent=80).select("doc_id", "kept"), f"{folder}/judged")
    gone = small(stage(judged.filter("doc_id is not null and not kept").select(F.col("doc_id").alias(gone_id)).distinct(), f"{folder}/gone"))
    again = small(stage(judged.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(again_id)), f"{folder}/again"))
    kept = docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")
    repeated = F.col("doc_id").eqNullSafe(F.col(again_id))
    once = kept.join(again, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, repeated, "left_anti").unionByName(once)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def budget(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture selects them. Each row is selected for itself, also where ids repeat or are missing, so the rows of a leaf keep within its budget."""
    folder = scratch(spark)
    row, copies, copy = unused(docs, "_row"), unused(docs, "_copies"), unused(docs, "_copy")
    keyed = stage(docs.withColumn(row, F.monotonically_increasing_id()), f"{folder}/rows")
    chosen = mix(keyed, carry=[row]).filter("copies > 0").select(row, F.col("copies").cast("int").alias(copies))
    often = keyed.join(small(stage(chosen, f"{folder}/copies")), row)
    return often.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all texts in the range-coded file format, as read back: doc_id, start, n_tokens, ids_crc32."""
    return token_output(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("minhash_near_dedup", deduplicate),
    ("benchmark_decontamination", clean),
    ("mixture", budget),
    ("token_output", tokens),
]
#: The trees' scores, the index's searches and the tokenizer are beyond SQL; tests check the operators by brute force and the stages by columns and counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
