"""Counts of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tally(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Rows by key, missing names as '', and the grand total in `total`."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in by]
    counts = chunks.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))


def status_counter(chunks: DataFrame) -> DataFrame:
    """Rows by standard and status, the most first."""
    return chunks.groupBy("standard", "force_status").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "standard", "force_status")
