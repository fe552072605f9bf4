"""Connected components by alternating large-star and small-star rounds, each cut off as a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffled, stage

ROUNDS = 99


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(shuffled(least), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(id, component) for every id that an edge (u, v) names: the smallest id it is connected with. Null ends and loops take no part; with no edge, the result is empty.

    Rounds grow with the logarithm of the longest path; RuntimeError where they do not settle within ROUNDS.
    """
    now = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{folder}/cc0")
    digest = None
    for i in range(1, ROUNDS + 1):
        now = stage(_small_star(_large_star(now)).filter("u <> v").distinct(), f"{folder}/cc{i}")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == digest:
            break
        digest = tuple(seen)
    else:
        raise RuntimeError(f"components are not settled after {ROUNDS} rounds")
    ends = now.select("u", "v")
    roots = ends.select(F.col("v").alias("id")).distinct()
    return ends.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
