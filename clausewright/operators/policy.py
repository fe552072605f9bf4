"""What is answered in the end: kept, extracted or refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def relevance(questions: DataFrame, hits: DataFrame, min_run: int = 0) -> DataFrame:
    """(qid, in_domain, longest_run, n_hits, top_score, gate). No hits: out of domain. `min_run` 0 turns the gate off. A question's hits are its top k, so they are few."""
    per = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n_hits"), F.max(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("top_score"), F.collect_list(F.coalesce("text", F.lit(""))).alias("_texts"))
    rows = questions.select("qid", "question").join(per, "qid", "left")
    run = T.longest_run(F.col("question"), F.coalesce("_texts", F.array().cast("array<string>")))
    rows = rows.withColumn("longest_run", run).withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    return rows.select("qid", ((F.col("n_hits") > 0) & ((F.lit(min_run) <= 0) | (F.col("longest_run") >= min_run))).alias("in_domain"), "longest_run", "n_hits", F.round("top_score", 4).alias("top_score"), F.lit("on" if min_run > 0 else "off").alias("gate"))


def extracts(hits: DataFrame, most: int = 400) -> DataFrame:
    """(qid, extract, source): the best hit that has text, standard and number, quoted with its origin. Ties: the smaller rank."""
    text, standard, number, name = (T.strip(F.coalesce(F.col(c), F.lit(""))) for c in ("text", "standard", "article_no", "standard_name"))
    label = F.concat(F.when(name != "", F.concat(F.lit("《"), name, F.lit("》"))).otherwise(""), standard)
    table = F.coalesce(F.col("kind") == "table", F.lit(False)) | F.contains(number, F.lit("-"))
    label = F.when(table, F.concat(label, F.lit(" 表 "), number)).otherwise(F.concat(label, F.lit(" 第 "), number, F.lit(" 条")))
    body = F.concat(F.lit(R.EXTRACT_HEAD + "\n"), T.shortened(text, most), F.lit("\n——出处："), label)
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    usable = hits.filter((text != "") & (standard != "") & (number != ""))
    made = usable.select("qid", (-score).alias("_order"), "rank", body.alias("extract"), F.struct(standard.alias("standard"), number.alias("article_no"), name.alias("standard_name"), F.round(score, 4).alias("score")).alias("source"))
    best = made.groupBy("qid").agg(F.min_by(F.struct("extract", "source"), F.struct("_order", "rank", "extract")).alias("b"))
    return best.select("qid", "b.extract", "b.source")


def apply_policy(verified: DataFrame, extract: DataFrame, relevant: DataFrame | None = None) -> DataFrame:
    """`verified` with final, strategy (keep, extractive, refuse), degraded and sources: what is cited of a kept answer, the origin of an extract, nothing of a refusal. Questions out of domain get no extract."""
    rows = verified.join(extract, "qid", "left")
    if relevant is not None:
        rows = rows.join(relevant.select("qid", "in_domain"), "qid", "left")
    domain = F.lit(True) if relevant is None else F.coalesce("in_domain", F.lit(True))
    strategy = F.when(F.col("refusal_only"), "refuse").when(F.col("ok"), "keep").when(~domain, "refuse").when(F.col("extract").isNotNull(), "extractive").otherwise("refuse")
    rows = rows.withColumn("strategy", strategy)
    final = F.when(F.col("strategy") == "keep", F.col("answer")).when(F.col("strategy") == "extractive", F.col("extract")).otherwise(R.NO_HIT_REPLY)
    full = lambda standard, number, name, score: F.struct(standard.alias("standard"), number.alias("article_no"), name.alias("standard_name"), score.alias("score"))
    kept = F.transform("cited", lambda c: full(c["standard"], c["article_no"], F.lit(None).cast("string"), F.lit(None).cast("double")))
    quoted = F.array(full(F.col("source.standard"), F.col("source.article_no"), F.col("source.standard_name"), F.col("source.score")))
    sources = F.when(F.col("strategy") == "keep", kept).when(F.col("strategy") == "extractive", quoted).otherwise(F.array().cast("array<struct<standard:string,article_no:string,standard_name:string,score:double>>"))
    rows = rows.withColumn("sources", sources)
    return rows.withColumn("final", final).withColumn("degraded", ~F.col("refusal_only") & ~F.col("ok"))


def refused(decided: DataFrame, used_model: str = "used_model") -> DataFrame:
    """`decided` with `refused`: by policy, by the model, or unverified without a model."""
    return decided.withColumn("refused", (F.col("strategy") == "refuse") | F.col("refusal_only") | (~F.col("ok") & ~F.col(used_model)))


def summarize(decided: DataFrame) -> DataFrame:
    """What a client may see of a decision: verdicts, no texts of the model; with `in_domain`, n_hits and top_score where `decided` has them."""
    more = [c for c in ("in_domain", "n_hits", "top_score") if c in decided.columns]
    relevance = [F.struct(*more).alias("relevance")] if more else []
    return decided.select("qid", "ok", "codes", "cited", "unverified", "coverage", "strategy", "degraded", *relevance)
