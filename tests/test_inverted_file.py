import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.operators import inverted_file, search
from clausewright.operators.inverted_file import InvertedFile
from clausewright.plans import ask

SCHEMA = "id long, embedding array<double>, label int"


def clustered(n=3000, dim=16, groups=40, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return [(i, (centres[i % groups] + rng.normal(size=dim) / 6).tolist(), i % 3) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    bad = [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [float("nan")] * 16, 0), (9003, [1.0], 0), (9004, [], 0), (9005, [None] * 16, 0)]
    hot = [(20_000 + i, clustered(1)[0][1], 5) for i in range(900)]  # a quarter of all rows is one vector
    return spark.createDataFrame(clustered() + bad + hot, SCHEMA).cache()


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return InvertedFile.build(rows, str(tmp_path_factory.mktemp("ivf") / "index"), cells=32)


def asked(rows, step=50):
    return rows.filter(f"id % {step} = 0 and id < 3000").selectExpr("id as qid", "embedding as qvector")


def pairs(found):
    return {(r.qid, r.id): (r.rank, r.score, r.label) for r in found.collect()}


def test_recall_and_pruning(rows, index, tmp_path):
    settings = index.settings()
    assert settings["probes"] < 16 and index.rows().count() == 3900  # rows without a score are in no cell
    got, want = pairs(index.search(asked(rows), str(tmp_path / "a"), 10)), pairs(search.top_k(rows, asked(rows), 10))
    assert len(got) == len(want) and len(got.keys() & want.keys()) >= 0.95 * len(want)
    assert all(abs(got[p][1] - want[p][1]) < 1e-12 for p in got.keys() & want.keys())
    plan = index.candidates([3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "cell#" in plan.split("PartitionFilters:")[1].split("]")[0] and "IN (3,5)" in plan.split("PartitionFilters:")[1]
    assert index.candidates([3, 5]).select("cell").distinct().count() <= 2


def test_all_cells_are_exact(rows, index, tmp_path):
    assert pairs(index.search(asked(rows), str(tmp_path / "a"), 7, {"label": 1}, 0.2, True, probes=32)) == pairs(search.top_k(rows, asked(rows), 7, {"label": 1}, 0.2, True))


def test_a_rare_predicate_looks_further(rows, index, tmp_path, monkeypatch):
    where = {"id": {"$in": [1, 7, 500, 1207, 2999]}}
    want = pairs(search.top_k(rows, asked(rows), 10, where))
    assert pairs(index.search(asked(rows), str(tmp_path / "a"), 10, where, probes=1)) == want and len(want) == 60 * 5
    monkeypatch.setattr(search, "QUESTIONS", 7)
    assert pairs(index.search(asked(rows), str(tmp_path / "b"), 10, where, probes=1)) == want


def test_rows_are_added_to_their_cells(spark, rows, tmp_path):
    grown = InvertedFile.build(rows.filter("id < 2000"), str(tmp_path / "grown"), cells=16)
    grown.add(rows.filter("id >= 2000"))
    assert grown.rows().count() == 3900
    got, want = pairs(grown.search(asked(rows), str(tmp_path / "a"), 10, probes=16)), pairs(search.top_k(rows, asked(rows), 10))
    assert got == want
    with pytest.raises(ValueError, match="other columns"):
        grown.add(rows.drop("label"))


def test_answers_from_an_index(spark, tmp_path):
    clauses = [(f"c{i}", f"正文{i}", "GB 50001-2019", f"6.1.{i + 1}", "article" if i % 2 else "table", [float(i % 4 == j) + 0.01 * i for j in range(4)]) for i in range(12)]
    chunks = spark.createDataFrame(clauses, "id string, text string, standard string, article_no string, kind string, embedding array<double>")
    for c in ("standard_name", "version", "status", "force_status"):
        chunks = chunks.withColumn(c, F.lit("x"))
    questions = spark.createDataFrame([(i, f"正文{i}", clauses[i][5]) for i in range(12)], "qid int, question string, qvector array<double>")
    chat = lambda system, user: "【GB 50001-2019】第 " + user.split("条文号 ")[1].split(" ")[0] + " 条。"
    exact = {r.qid: r for r in ask.ask_batch(chunks, questions, chat, k=2).collect()}
    index = InvertedFile.build(chunks, str(tmp_path / "index"), cells=4)
    found = {r.qid: r for r in ask.ask_batch(chunks, questions, chat, k=2, index=index, answers_path=str(tmp_path / "answers")).collect()}
    assert {q: (r.strategy, r.final) for q, r in found.items()} == {q: (r.strategy, r.final) for q, r in exact.items()}
    assert {r.strategy for r in found.values()} == {"keep"}
    silent = lambda system, user: 1 / 0
    again = ask.ask_batch(chunks, questions, silent, k=2, index=index, answers_path=str(tmp_path / "answers")).collect()  # all are answered
    assert {r.qid: r.final for r in again} == {q: r.final for q, r in found.items()}


def test_little(spark, rows, index, tmp_path):
    nothing = InvertedFile.build(rows.limit(0), str(tmp_path / "none"))
    assert nothing.search(asked(rows), str(tmp_path / "a")).count() == 0
    one = InvertedFile.build(rows.filter("id in (0, 9001, 9003)"), str(tmp_path / "one"))
    assert {p[1] for p in pairs(one.search(asked(rows), str(tmp_path / "b")))} == {0}
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [0.0] * 16)], "qid long, qvector array<double>")
    assert index.search(odd, str(tmp_path / "c")).count() == 0
    with pytest.raises(ValueError, match="cell"):
        InvertedFile.build(rows.withColumn("cell", rows.id), str(tmp_path / "d"))
    assert inverted_file.CELLS >= 32
