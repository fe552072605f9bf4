"""Clause rows from JSON lines, and identity of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

CHUNKS = "id string, text string, standard string, standard_name string, version string, article_no string, chapter string, page_start int, page_end int, kind string, status string, force_status string"


def without_sections(chunks: DataFrame) -> DataFrame:
    """Rows of kind `section` go; rows without a kind stay."""
    return chunks.filter(~F.col("kind").eqNullSafe("section"))


def dropped_sections(chunks: DataFrame) -> DataFrame:
    """How many rows without_sections() drops: `dropped`."""
    return chunks.agg(F.count_if(F.col("kind").eqNullSafe("section")).alias("dropped"))


def read_chunks(spark: SparkSession, path: str, seen: Observation | None = None) -> DataFrame:
    """Rows of JSON lines without sections. `seen` gets, from the first action on the rows, how many were read and how many of them dropped: `rows`, `dropped`."""
    rows = spark.read.schema(CHUNKS).json(path)
    if seen is not None:
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("kind").eqNullSafe("section")).alias("dropped"))
    return without_sections(rows)


def content_identity(content: Column) -> Column:
    """SHA-1 of bytes (or of a text's UTF-8), in hexadecimal."""
    return F.sha1(content)


def positioned_chunks(spark: SparkSession, path: str, segment: int = 65_536) -> DataFrame:
    """Rows of one file of JSON lines without blank lines and sections, with `pos`: their position among those rows, from 0, as the rows of a matrix are counted.

    Kept rows are counted in segments of lines, whose sums are carried forward; no task holds more than a segment's positions.
    """
    lines = read_marked_text(spark, path).filter(F.trim("text") != "")
    rows = lines.select(F.floor(F.col("line") / segment).alias("_segment"), F.col("line").alias("_line"), F.from_json("text", CHUNKS, {"mode": "FAILFAST"}).alias("c"))
    rows = rows.filter(~F.col("c.kind").eqNullSafe("section"))
    counts = rows.groupBy("_segment").agg(F.count(F.lit(1)).alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_segment").orderBy("_line")) - 1 + F.col("_first")
    return rows.join(counts.select("_segment", first.alias("_first")), "_segment").select(place.cast("long").alias("pos"), "c.*")


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha1) of the bytes of each file."""
    return spark.read.format("binaryFile").load(path).select("path", content_identity(F.col("content")).alias("sha1"))


def read_marked_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of text files of any size, one row a line, lines counted from 0 in each file.

    A file is read in blocks by many tasks. A block's lines are counted by themselves, and start where the blocks before it end;
    the rows that are carried over a file are one for each block.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("text")
    )
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", (before - F.col("first")).alias("offset"))
    return lines.join(starts, ["file", "block"]).select("file", (F.col("at") + F.col("offset")).alias("line"), "text")
