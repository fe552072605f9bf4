import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.operators import search


def brute(rows, asked, k):
    """(qid, rank, id), rows of the question's own id left out."""
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    out = set()
    for q, v in asked:
        v = np.array(v, float)
        score = np.round((unit * (v / np.sqrt((v * v).sum()))).sum(axis=1), 12)
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out |= {(q, n, int(ids[i])) for n, i in enumerate(best, 1)}
    return out


def test_one_file_is_dealt_over_tasks(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(2101, 8)).tolist())]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>")
    frame.coalesce(1).write.parquet(str(tmp_path / "rows"))
    one = spark.read.parquet(str(tmp_path / "rows"))
    assert len(one.inputFiles()) == 1
    found = search.top_k(one, one.select(F.col("id").alias("qid"), F.col("embedding").alias("qvector")), 3, others_only=True, carry_vectors=False)
    assert len(found.inputFiles()) >= 8
    assert {(r.qid, r.rank, r.id) for r in found.collect()} == brute(rows, rows, 3)


@pytest.mark.parametrize("pairs", [1, 50, 32_768])
def test_many_equal_rows_and_own_ids(spark, monkeypatch, pairs):
    monkeypatch.setattr(search, "PAIRS", pairs, raising=False)
    rows = [(i, [3.0, 4.0] if i % 3 else [float(i % 5), 1.0]) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>").coalesce(2)
    asked = [(q, rows[q][1]) for q in (0, 1, 7, 9, 199)]
    found = search.top_k(frame, spark.createDataFrame(asked, "qid long, qvector array<double>"), 4, others_only=True)
    assert {(r.qid, r.rank, r.id) for r in found.collect()} == brute(rows, asked, 4)
