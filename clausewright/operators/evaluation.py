"""Retrieval evaluation: recall, reciprocal rank, rank distribution, thresholds, slices, average precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Size of a sketch: with 200, a merged one is off by 1.65 % of the ranks at most, with 99 % confidence.
SKETCH = 200


def gold_ranks(questions: DataFrame, hits: DataFrame, gold: DataFrame, on: list[str]) -> DataFrame:
    """(qid, best_rank, gold_score): each question's best hit among its gold rows, which match on `on` (with qid); null where none is among the hits."""
    found = hits.join(gold.select("qid", *on).distinct(), ["qid", *on], "left_semi")
    best = found.groupBy("qid").agg(F.min("rank").alias("best_rank"), F.max("score").alias("gold_score"))
    return questions.select("qid").join(best, "qid", "left")


def recall_at(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    hit = [F.avg(F.coalesce((F.col("best_rank") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in ks]
    return ranks.agg(F.count(F.lit(1)).alias("n"), *hit)


def mean_reciprocal_rank(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.avg(F.coalesce(F.lit(1.0) / F.col("best_rank"), F.lit(0.0))).alias("mrr"))


def rank_distribution(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("best_rank").agg(F.count(F.lit(1)).alias("n"))


def threshold_window(ranks: DataFrame, negatives: DataFrame, share: float = 0.05) -> DataFrame:
    """The low percentile (interpolated) of gold scores and the highest score of a negative; they overlap where a threshold cannot part them."""
    low = ranks.agg(F.percentile("gold_score", F.lit(share)).alias("low_gold"))
    return low.crossJoin(negatives.agg(F.max("score").alias("top_negative"))).withColumn("separable", F.col("top_negative") < F.col("low_gold"))


def threshold_sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """`scores` (score, positive): for each threshold the negatives at or above it and the positives below it, in one pass."""
    steps = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    return scores.select("score", "positive", steps).groupBy("threshold").agg(F.count_if(~F.col("positive") & (F.col("score") >= F.col("threshold"))).alias("negatives_over"), F.count_if(F.col("positive") & (F.col("score") < F.col("threshold"))).alias("positives_under"))


def threshold_curve(scores: DataFrame, folder: str) -> DataFrame:
    """`scores` (score, positive) to (threshold, negatives_over, positives_under, errors): for each distinct score as threshold, the negatives at or above it, the positives below it, and their sum.

    Scores are dealt over ranges; each range's counts are carried to those above it (a row for each range), and the running
    counts are made within each range, all from below: Spark sums a frame that ends at the last row anew for each row, so the
    negatives at or above a score are all but those below it. Null scores go; a null `positive` counts on neither side.
    `folder`: a new one that all executors share, in which the ranges are fixed.
    """
    per = scores.filter("score is not null").groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    per = staged(per.repartitionByRange("score").withColumn("range", F.spark_partition_id()), folder)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = per.groupBy("range").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))  # no more rows than partitions
    carried = sums.select("range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_below") for c in "pn"), F.sum("n").over(Window.partitionBy()).alias("negatives"))
    below = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    p_under, n_under = (F.col(f"{c}_below") + F.coalesce(F.sum(c).over(below), F.lit(0)) for c in "pn")
    curve = per.join(F.broadcast(carried), "range").select(F.col("score").alias("threshold"), (F.col("negatives") - n_under).alias("negatives_over"), p_under.alias("positives_under"))
    return curve.withColumn("errors", F.col("negatives_over") + F.col("positives_under"))


def best_cut(curve: DataFrame) -> DataFrame:
    """The threshold of the fewest errors, of several the smallest, with its counts."""
    return curve.agg(F.min_by(F.struct(*curve.columns), F.struct("errors", "threshold")).alias("b")).select("b.*")


def score_sketches(rows: DataFrame, by: list[str], score_col: str = "gold_score", size: int = SKETCH) -> DataFrame:
    """(the slice's columns, n, sketch): a mergeable sketch of each slice's scores, to be stored. Null scores count in none; a slice without a score has a null sketch."""
    score = F.col(score_col).cast("double")
    return rows.groupBy(*by).agg(F.count(score).alias("n"), F.kll_sketch_agg_double(score, size).alias("sketch")).withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def sketched_percentile(sketches: DataFrame, by: list[str], share: float = 0.05) -> DataFrame:
    """(by, n, low): the percentile of the scores of merged slices, off by the sketch's error in rank; null where no slice has a score."""
    some = sketches.filter("n > 0").groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return some.select(*by, "n", F.kll_sketch_get_quantile_double("sketch", F.lit(share)).alias("low"))


def slices(ranks: DataFrame, by: list[str], k: int = 1) -> DataFrame:
    """Recall at k for every value of each column in `by`, and over all (null everywhere), with `slice`, the column's name."""
    sets = [[c] for c in by] + [[]]
    name = F.coalesce(*[F.when(F.grouping(c) == 0, c) for c in by], F.lit("all"))
    return ranks.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(name.alias("slice"), F.count(F.lit(1)).alias("n"), F.avg(F.coalesce((F.col("best_rank") <= k).cast("double"), F.lit(0.0))).alias("recall"))


def context_precision(judged: DataFrame) -> DataFrame:
    """`judged` (qid, rank, relevant): the mean of the precision at each relevant rank; 0 where nothing is relevant."""
    order = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at = judged.withColumn("precision", F.sum(F.col("relevant").cast("int")).over(order) / F.col("rank"))
    return at.groupBy("qid").agg(F.coalesce(F.avg(F.when(F.col("relevant"), F.col("precision"))), F.lit(0.0)).alias("context_precision"))
