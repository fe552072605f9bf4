import pytest

from clausewright.operators import search
from clausewright.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def vectors(spark, n):
    return spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), float(i % 3)]) for i in range(n)], "id long, embedding array<float>")


def test_questions_beyond_one_block(spark, monkeypatch):
    rows = vectors(spark, 40).union(spark.createDataFrame([(50, None), (51, [0.0] * 3), (52, [1.0, float("nan"), 1.0]), (53, [1.0, None, 1.0]), (54, [1.0])], "id long, embedding array<double>"))
    asked = rows.selectExpr("id as qid", "embedding as qvector").union(spark.createDataFrame([(None, [1.0, 0.0, 0.0]), (99, None)], "qid long, qvector array<double>"))
    how = {"k": 3, "where": {"id": {"$ne": 4}}, "others_only": True, "min_score": 0.5}
    one = sorted(str(tuple(r)) for r in search.top_k(rows, asked, **how).select("qid", "rank", "id", "score").collect())
    data = {r.id: r.embedding for r in vectors(spark, 40).collect()}
    for q, v in [*data.items(), (None, [1.0, 0.0, 0.0])]:
        score = {i: sum(a * b for a, b in zip(v, w)) / (sum(a * a for a in v) ** 0.5 * sum(b * b for b in w) ** 0.5) for i, w in data.items() if i not in (q, 4)}
        best = sorted(score, key=lambda i: (-round(score[i], 12), i))[:3]
        got = [(r.rank, r.id) for r in search.top_k(rows, asked.filter(search.F.col("qid").eqNullSafe(q)), **how).collect()] if q in (0, 9, None) else None
        assert got is None or sorted(got) == list(enumerate(best, 1))
    monkeypatch.setattr(search, "QUESTIONS", 6)
    found = search.top_k(rows, asked, **how).select("qid", "rank", "id", "score").collect()
    assert sorted(str(tuple(r)) for r in found) == one and {r.qid for r in found} == {None, *range(40)}
    assert search.top_k(rows, asked.limit(0), **how).count() == 0


def test_more_questions_than_the_default_block(spark):
    rows = vectors(spark, 10_001)
    found = search.top_k(rows.limit(20), rows.selectExpr("id as qid", "embedding as qvector"), 1)
    assert found.select("qid").distinct().count() == 10_001


@pytest.mark.parametrize("name", ["recall_at_k", "precision_at_rank_map", "eval_slices", "vector_topk_filtered_and", "min_score_postfilter"])
def test_queries_in_blocks(spark, monkeypatch, name):
    one = sorted(map(str, QUERIES[name](spark, DATA).collect()))
    monkeypatch.setattr(search, "QUESTIONS", 3)
    assert sorted(map(str, QUERIES[name](spark, DATA).collect())) == one
