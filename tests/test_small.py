import random
import time

import pytest
from pyspark.sql import functions as F

from clausewright.config import Config
from clausewright.functions import text as T
from clausewright.functions.runs import greedy_longest
from clausewright.operators import corpus, predicates, quality_gate, search
from clausewright.plans import ask
from clausewright.streaming.answers import verify_stream


def test_exit_code(spark):
    for states, want in ((["PASS", "FAIL"], 1), (["SKIP"], 1), (["PASS"], 0), ([], 0)):
        assert quality_gate.exit_code(spark.createDataFrame([(s,) for s in states], "status string")).first().exit_code == want


def test_text_helpers(spark):
    rows = spark.createDataFrame([("sk-1234567890", "书库的净高如何规定", "甲" * 401), ("short", None, None), (None, None, None), ("", None, None), ("1234567890", None, None)], "secret string, question string, long string")
    got = rows.select(T.mask(F.col("secret")).alias("m"), T.question_segments(F.col("question")).alias("s"), T.shortened(F.col("long")).alias("x")).collect()
    assert [r.m for r in got] == ["sk-…7890（长度 13）", "sh***", "(未设置)", "(未设置)", "12********"]
    assert got[0].s == ["书库", "净高"] and got[1].s == []
    assert got[0].x == "甲" * 400 + "……" and got[1].x is None


def test_config():
    assert Config.load({}) == Config() and Config.load({"CLAUSEWRIGHT_TOP_K": " 7 ", "CLAUSEWRIGHT_CHAT_MODEL": " "}).top_k == 7


def test_clauses_of_a_standard(spark):
    text = ["前言", "条文说明", "<!-- page 1 -->", "6 总则", "6.1 节", "6.1.1 甲", "12", "<!-- page 2 -->", "续", "6.1.2 乙", "6.2 节", "附：条文说明", "6.1.1 说明"]
    lines = spark.createDataFrame([("a", i, t) for i, t in enumerate(text)] + [("b", 0, None), ("c", 0, "前言")], "file string, line int, text string")
    got = corpus.split_clauses(lines).orderBy("article_no").collect()
    assert [tuple(r) for r in got] == [("a", "6.1.1", "6.1.1 甲\n续", 1, 2), ("a", "6.1.2", "6.1.2 乙", 2, 2)]
    assert corpus.split_clauses(lines.limit(0)).count() == 0


def test_missing_metadata(spark):
    hits = spark.createDataFrame([(1, 1, None, None, "正文", 0.25)], "qid int, rank int, standard string, article_no string, text string, score double")
    shown = search.hit_projection(hits).first()
    assert (shown.standard, shown.chapter, shown.page, shown.score) == ("", "", "", 0.25)
    for c in ("standard_name", "version", "status", "force_status"):
        hits = hits.withColumn(c, F.lit(None).cast("string"))
    assert ask.render(hits).first().context == "【片段 1】【? ?（?）】条文号 ? ［；］\n正文"


@pytest.mark.parametrize("pages", [1, 2])
def test_verify_stream(spark, tmp_path, pages):
    answers = [(i, "见第 6.1.1 条。" if i % 2 else "没有。") for i in range(4)]
    for p in range(pages):
        spark.createDataFrame(answers[p::pages], "qid int, answer string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    hits = spark.createDataFrame([(i, "GB 50001-2019", "6.1.1") for i in range(4)], "qid int, standard string, article_no string")
    stream = spark.readStream.schema("qid int, answer string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run = verify_stream(stream, hits, lambda found, number: found.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={number}")), str(tmp_path / "at"))
    run.processAllAvailable()
    run.stop()
    assert {(r.qid, r.ok) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(i, i % 2 == 1) for i in range(4)}


def test_long_runs_take_time_in_proportion(spark):
    """A run of a million spaces or digits, which patterns that start anew at each character would take hours for."""
    n = 1_000_000
    texts = {"spaces": "a" + " " * n + "b" + " " * n, "digits": "1" * n, "after": "T" + " " * n + "x", "levels": "1" + " " * n + "1.2", "marks": "附" + " " * n + "a", "wide": "\u3000" * n + "x\u3000"}
    rows = spark.createDataFrame(list(texts.items()), "name string, text string").cache()
    rows.count()
    t = F.col("text")
    began = time.monotonic()
    found = {r.name: r for r in rows.select("name", T.strip(t).alias("s"), T.article_numbers(t).alias("a"), T.standards(t).alias("d"), T.article_key(t).alias("k"), F.size(T.sentences(t)).alias("n")).collect()}
    assert time.monotonic() - began < 60
    assert found["spaces"].s == "a" + " " * n + "b" and found["wide"].s == "x" and found["levels"].a == ["1.2"] and not found["digits"].a


def test_predicates_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, label string").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    for where, ids, pushed in (({"label": {"$in": ["a", "c"]}}, {1}, "In(label, [a,c])"), ({"$and": [{"label": {"$in": ["a", "b"]}}, {"id": {"$ne": 1}}]}, {3}, "In(label, [a,b])"), ({"$or": [{"label": {"$in": ["b"]}}, {"id": 2}]}, {2, 3}, "")):
        found = rows.filter(predicates.compile_where(where))
        assert {r.id for r in found.collect()} == ids
        assert pushed in found._jdf.queryExecution().executedPlan().toString()
    assert rows.filter(predicates.compile_where({"label": {"$in": []}})).count() == 0


def test_runs_of_question_and_texts(spark):
    rng = random.Random(2)

    def greedy(segments, texts):
        best = 0
        for s in segments:
            at = 0
            while at < len(s):
                n = next((n for n in range(len(s) - at, 1, -1) if any(s[at : at + n] in t for t in texts)), 0)
                best, at = max(best, n), at + max(n, 1)
        return best

    for _ in range(2000):
        letters = "甲乙丙"[: rng.randint(1, 3)]
        segments = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 3))]
        texts = ["".join(rng.choice(letters + "x\n") for _ in range(rng.randint(0, 15))) for _ in range(rng.randint(0, 4))]
        assert greedy_longest(segments, texts) == greedy(segments, texts)
    long = "".join(rng.choice("甲乙丙丁") for _ in range(200_000))
    began = time.monotonic()
    assert greedy_longest([long[:20_000]], [long, "乙" * 100_000]) == 20_000 and time.monotonic() - began < 10
    rows = spark.createDataFrame([("图书馆阅览室", ["阅览室面积", None]), (None, ["甲乙"]), ("甲乙", None), ("甲乙", []), ("甲乙x丙丁", ["甲乙丙丁"])], "q string, t array<string>")
    assert [r.n for r in rows.select(T.longest_run(F.col("q"), F.col("t")).alias("n")).collect()] == [3, 0, 0, 0, 4]
