"""Corpus preparation: status of clauses, and clauses cut from page-marked text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import base_number, strip


def listed_clauses(spark) -> DataFrame:
    """(standard, article_no, force_status) of all listed clauses."""
    return spark.createDataFrame([(s, a, status) for s, status, articles in R.LISTED for a in articles], "standard string, article_no string, force_status string")


def force_status(standard: Column, number: Column) -> Column:
    """The status of a clause; UNKNOWN for a standard without rules."""
    out = F.when(standard.isin(*R.FULL_STANDARDS), R.FULL)
    for name, status, articles in R.LISTED:
        out = out.when(standard == name, F.when(base_number(number).isin(*articles), status).otherwise(R.NONE))
    return out.otherwise(R.UNKNOWN)


def listed_missing(chunks: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Listed clauses that the corpus lacks."""
    rules = listed_clauses(chunks.sparkSession) if listed is None else listed
    have = chunks.select("standard", base_number(F.col("article_no")).alias("article_no")).distinct()
    return F.broadcast(rules).join(have, ["standard", "article_no"], "left_anti")


def without_rules(chunks: DataFrame) -> DataFrame:
    """Standards of the corpus for which no rule gives a status."""
    known = [*R.FULL_STANDARDS, *(s for s, *_ in R.LISTED)]
    return chunks.select("standard").distinct().filter(~F.coalesce(F.col("standard").isin(*known), F.lit(False)))


def untraced(contexts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of `contexts` (text) whose exact text no chunk has; a null text is in none."""
    have = chunks.select(F.sha2("text", 256).alias("_text"), F.length("text").alias("_chars")).distinct()
    rows = contexts.withColumn("_text", F.sha2("text", 256)).withColumn("_chars", F.length("text"))
    return rows.join(have, ["_text", "_chars"], "left_anti").drop("_text", "_chars")


#: Lines of a file that are looked at together.
SEGMENT = 4096


def split_clauses(lines: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """`lines` (file, line, text; lines count up within a file) to clauses: file, article_no, text, page_start, page_end.

    A line that starts with a number of three levels opens a clause; titles of one or two levels close it and open none. A
    page mark `<!-- page N -->` sets the page of what follows; a bare number that is the last line of a page is its footer.
    What stands before a file's first clause goes, and behind its clauses what follows a line that is the heading of the
    explanations alone. Other lines stay in the clause that is open, whatever their page.

    A file may be larger than a task: its lines are scanned in segments of `segment` numbers. Each segment is summed up in one
    row (its last page, last opening, first line behind a mark, whether it opens clauses, where its last heading of
    explanations is); these rows are carried forward over the file, and each segment is then cut by itself. Only the lines of
    one clause meet in one task. Lines of a null file are one file.
    """
    local = Window.partitionBy("of", "segment").orderBy("line")
    here = local.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select(F.struct("file").alias("of"), F.col("line").cast("long").alias("line"), strip(F.coalesce("text", F.lit(""))).alias("text")).withColumn("segment", F.floor(F.col("line") / segment))
    rows = rows.withColumn("mark", F.regexp_extract("text", r"^<!--\s*+page\s++(\d++)\s*+-->$", 1))
    rows = rows.withColumn("mark", F.when(F.col("mark") != "", F.col("mark").cast("int")))
    number = F.regexp_extract("text", r"^(\d{1,2}\.\d{1,3}\.\d{1,3})(?![.\d])", 1)
    title = F.col("text").rlike(r"^\d{1,2}(\.\d{1,3})?\s+\D")
    content = F.col("mark").isNull() & (F.col("text") != "")
    rows = rows.withColumn("content", content)  # all that is read from a text stands below the windows: what sums up a segment has no texts to carry
    rows = rows.withColumn("number", F.when(content, number)).withColumn("opens", F.coalesce(F.col("number") != "", F.lit(False)))
    rows = rows.withColumn("cut", F.coalesce(content & (F.col("opens") | title), F.lit(False))).withColumn("heading", content & F.col("text").rlike(R.BACK_MATTER))
    rows = rows.withColumn("page", F.last("mark", ignorenulls=True).over(here))

    first = F.min(F.when(F.col("content"), F.struct("line", F.col("page").alias("page"))))
    state = rows.groupBy("of", "segment").agg(
        F.max(F.when(F.col("mark").isNotNull(), F.struct("line", "mark")))["mark"].alias("last_page"),
        F.max(F.when(F.col("cut"), F.struct("line", F.coalesce("number", F.lit("")).alias("number"))))["number"].alias("last_number"),
        F.sum(F.col("cut").cast("long")).alias("cuts"),
        first.isNotNull().alias("some"),
        first["page"].alias("first_page"),
        F.min(F.when(F.col("opens"), F.col("line"))).alias("first_opens"),
        F.max(F.when(F.col("heading"), F.col("line"))).alias("last_heading"),
    )
    whole = Window.partitionBy("of").orderBy("segment")  # a row for each segment
    before, behind = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(1, Window.unboundedFollowing)
    state = state.withColumn("page_in", F.last("last_page", ignorenulls=True).over(before))
    state = state.withColumn("first_page", F.when(F.col("some"), F.struct(F.coalesce("first_page", "page_in").alias("page"))))
    state = state.withColumn("opened_in", F.coalesce(F.max(F.col("first_opens").isNotNull()).over(before), F.lit(False)))
    ends = F.col("last_heading").isNotNull() & (F.col("opened_in") | F.coalesce(F.col("last_heading") > F.col("first_opens"), F.lit(False)))
    state = state.withColumn("back_in", F.coalesce(F.max(ends).over(before), F.lit(False)))
    state = state.withColumn("number_in", F.last("last_number", ignorenulls=True).over(before)).withColumn("cuts_in", F.coalesce(F.sum("cuts").over(before), F.lit(0)))
    state = state.withColumn("next_page", F.first("first_page", ignorenulls=True).over(behind))
    carried = state.select("of", "segment", "page_in", "opened_in", "back_in", "number_in", "cuts_in", "next_page")

    rows = rows.join(carried, ["of", "segment"]).filter("content and not back_in").withColumn("page", F.coalesce("page", "page_in"))
    opened = F.col("opened_in") | F.max("opens").over(here)
    rows = rows.withColumn("heading", F.col("heading") & opened).withColumn("back", F.max("heading").over(here))
    follows = F.coalesce(F.lead(F.struct("page")).over(local), F.col("next_page"))
    footer = F.col("text").rlike(r"^\d{1,3}$") & (follows.isNull() | ~follows["page"].eqNullSafe(F.col("page")))
    rows = rows.withColumn("footer", footer).withColumn("clause", F.col("cuts_in") + F.sum(F.col("cut").cast("long")).over(here))
    rows = rows.withColumn("article_no", F.coalesce(F.last(F.when(F.col("cut"), F.coalesce("number", F.lit(""))), ignorenulls=True).over(here), "number_in"))
    rows = rows.filter("not back and not footer and article_no <> ''")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    out = rows.groupBy("of", "clause").agg(F.first("article_no").alias("article_no"), body.alias("text"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    return out.select("of.file", "article_no", "text", "page_start", "page_end")
