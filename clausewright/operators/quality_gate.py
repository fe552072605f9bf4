"""Checks that a corpus passes before it is published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .corpus import force_status, listed_missing

#: An article of fewer characters is taken for damaged.
LEAST_CHARS = 10


def gate(chunks: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(check, failures, status) for: section rows, wrong status, blank text, short articles, listed clauses that are missing."""
    text = strip(F.coalesce("text", F.lit("")))
    expected = force_status(F.col("standard"), F.col("article_no"))
    checks = {
        "section_rows": F.col("kind") == "section",
        "force_status": ~F.col("force_status").eqNullSafe(expected),
        "blank_text": text == "",
        "short_text": (F.col("kind") == "article") & (text != "") & (F.length(text) < LEAST_CHARS),
    }
    counts = chunks.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    rows = counts.select(F.expr(f"stack({len(checks)}, {', '.join(f'{chr(39)}{n}{chr(39)}, {n}' for n in checks)}) as (check, failures)"))
    rows = rows.unionByName(listed_missing(chunks, listed).agg(F.count(F.lit(1)).alias("failures")).select(F.lit("listed_missing").alias("check"), "failures"))
    return rows.withColumn("status", F.when(F.col("failures") == 0, "PASS").otherwise("FAIL"))


def exit_code(checks: DataFrame) -> DataFrame:
    """1 if any check failed or was skipped, else 0; 0 without checks."""
    return checks.agg(F.coalesce(F.max(F.col("status").isin("FAIL", "SKIP").cast("int")), F.lit(0)).alias("exit_code"))
