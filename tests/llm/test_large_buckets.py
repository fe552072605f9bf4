from pyspark.sql import functions as F

from clausewright.llm import near_dedup


def test_common_shingles_are_counted_once_a_task(spark, tmp_path):
    """Near copies whose sets lie in many partitions: a row for each shingle, not for each shingle and partition."""
    docs = [(i, list(range(60)) + [1000 + 5 * i + j for j in range(5)]) for i in range(100)]
    sets = spark.createDataFrame(docs, "id long, shingles array<long>").repartition(32)
    digests = [near_dedup._set_digest(i).alias(f"all{i}") for i in (1, 2)]
    nodes = sets.select("id", F.size("shingles").alias("n"), F.col("id").alias("component"), F.array(F.lit(1).cast("long")).alias("keys"), *digests)
    pairs = near_dedup._large_bucket_pairs(nodes, sets, 85, str(tmp_path))
    assert {(r.u, r.v) for r in pairs.collect()} == {(i, 0) for i in range(1, 100)}
    made = spark.read.parquet(str(tmp_path / "large_shingles"))
    assert made.count() == 60 + 5 * 100
    assert made.filter("s < 1000").agg(F.min("n"), F.max("n")).first() == (100, 100)
