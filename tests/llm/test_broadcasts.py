import pytest
from pyspark.sql import functions as F

from clausewright.llm import common, components, near_dedup


def test_near_copies_are_not_broadcast_by_the_size_of_their_files(spark, monkeypatch):
    """Tables of near copies are a few kB as files; what reaches the driver for a broadcast has been counted by small() before."""
    plans, counted = {}, []

    def staged(df, path, write=common.stage):
        plans[path.rsplit("/", 1)[-1]] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, path)

    def told(df, small=common.small):
        counted.append(df)
        return small(df)

    monkeypatch.setattr(near_dedup, "stage", staged)
    monkeypatch.setattr(components, "stage", staged)
    monkeypatch.setattr(near_dedup, "small", told)
    monkeypatch.setattr(near_dedup, "LARGE", 4)
    texts = [" ".join([*(f"g{i}w{j}" for j in range(60)), *(f"own{i}x{k}x{j}" for j in range(k % 4))]) for i in range(12) for k in range(8)]
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=3, percent=85)
    last = got._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i - i % 8 for i in range(96)}
    assert {"first_pairs", "edges1", "cc1", "open", "listed", "bounds", "second_pairs", "edges2"} <= plans.keys()
    assert {name for name, plan in plans.items() if "BroadcastExchange" in plan} <= {"sets", "large", "large_shingles"} and len(counted) == 3
    assert "BroadcastExchange" not in last


@pytest.mark.parametrize("rows, sent", [(5, True), (4, False)])
def test_more_rows_than_counted_for_are_not_broadcast(spark, tmp_path, rows, sent):
    few = common.stage(spark.range(5), str(tmp_path / "few"))
    joined = spark.range(10).join(common.small(few, rows), "id", "left_anti")
    assert ("BroadcastExchange" in joined._jdf.queryExecution().executedPlan().toString()) is sent
    assert joined.agg(F.count(F.lit(1))).first()[0] == 5
