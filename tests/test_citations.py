import pytest

from clausewright.operators import citations, policy, predicates
from clausewright.plans import ask

HITS = [("GB 50352-2019", "2.0.16", 0.875), ("GB 50352-2019", "4.2.4", 0.812), ("GB 55031-2022", "3.1.6", 0.79), ("GB 55031-2022", "3.1.4", 0.702), ("GB 55037-2022", "2.2.6", 0.69), ("JGJ 38-2015", "4.2.8", 0.673), ("GB 1-2000", "4.3.5-表", 0.5), ("GB 1-2000", "附录B", 0.4), ("GB 2-2000", "4.2.2", 0.3), ("GB 3-2000", "4.2.2", 0.3)]
CASES = [
    ("依据【GB 50352-2019】第 9.9.9 条，应当。", ["not_in_hits"]),
    ("依据【GB 55031-2022】3.16，应当。", ["not_in_hits"]),
    ("按第 2.0.16 条，应当。", []),
    ("依据【GB 50352-2019】第 3.1.6 条，应当。", ["standard_mismatch"]),
    ("依据【GBJ 16-87】第 3.1.6 条，应当。", ["standard_mismatch"]),
    ("第 4.2.2 条规定了。", ["ambiguous_article"]),
    ("【GB 55031-2022】3.1.6。【JGJ 38-2015】第 4.2.8 条", []),
    ("", ["empty_answer"]),
    (None, ["empty_answer"]),
    ("本知识库未收录该内容。", ["model_refused"]),
    ("没有条文。", ["no_citation"]),
    ("依据【GB 50352-2019】。", ["no_citation"]),
    ("表 4.3.5 规定，净高 2.40m，取 1/3。", []),
    ("见附录B。", []),
]


@pytest.fixture(scope="module")
def verified(spark):
    answers = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "qid int, answer string")
    rows = [(q, r, s, n, x, f"正文{n}", "规范", "article") for q in range(len(CASES)) for r, (s, n, x) in enumerate(HITS, 1)]
    hits = spark.createDataFrame(rows, "qid int, rank int, standard string, article_no string, score double, text string, standard_name string, kind string")
    return citations.verify(answers, hits), hits


def test_codes(verified):
    got = {r.qid: r for r in verified[0].collect()}
    assert [got[i].codes for i in range(len(CASES))] == [c for _, c in CASES]
    assert all(got[i].ok == (not c) for i, (_, c) in enumerate(CASES))
    assert got[0].reasons == ["条文号 9.9.9 不在本次检索片段里"] and got[2].reasons == [] and len(got[7].reasons) == 1
    assert got[3].reasons == ["第 3.1.6 条出自 GB 55031-2022，答案却标成 GB 50352-2019"] and got[5].reasons == ["第 4.2.2 条在 GB 2-2000、GB 3-2000 里都有，答案没有指明出处"]
    assert got[11].standards_cited == ["GB 50352-2019"] and got[9].refusal_only and got[9].coverage == 1.0 and got[10].coverage == 0.0


def test_policy(verified):
    got = {r.qid: r for r in policy.apply_policy(verified[0], policy.extracts(verified[1])).collect()}
    assert (got[2].strategy, got[2].final) == ("keep", CASES[2][0])
    assert got[9].strategy == "refuse" and not got[9].degraded and got[9].sources == []
    assert [(x.standard, x.article_no) for x in got[2].sources] == [("GB 50352-2019", "2.0.16")] and [x.article_no for x in got[0].sources] == ["2.0.16"]
    assert "answer" not in policy.summarize(policy.apply_policy(verified[0], policy.extracts(verified[1]))).columns
    assert got[0].strategy == "extractive" and got[0].degraded and "正文2.0.16" in got[0].final and "9.9.9" not in got[0].final
    nothing = verified[1].limit(0)
    assert {r.strategy for r in policy.apply_policy(verified[0].filter("qid = 0"), policy.extracts(nothing)).collect()} == {"refuse"}


def test_predicates():
    assert predicates.with_default_kind(None) == {"kind": "article"}
    assert predicates.with_default_kind({"a": 1}) == {"$and": [{"a": 1}, {"kind": "article"}]}
    where = {"$and": [{"a": 1}, {"$or": [{"kind": "x"}, {"b": 2}]}]}
    assert predicates.with_default_kind(where) is where
    assert predicates.with_default_kind({"$and": [{"a": 1}, {"b": 2}]}) == {"$and": [{"a": 1}, {"b": 2}, {"kind": "article"}]}
    assert len(predicates.force_only(["s"])["$and"]) == 3 and predicates.combine(None, {}) is None


def test_ask_batch(spark):
    chunks = spark.createDataFrame([("a", [1.0, 0.0], "书库净高不应小于", "GB 1-2000", "1.0.1", "article"), ("b", [0.0, 1.0], "其他", "GB 1-2000", "1.0.2", "article"), ("c", [1.0, 0.0], "节", "GB 1-2000", "1.0", "section")], "id string, embedding array<double>, text string, standard string, article_no string, kind string")
    for c in ("standard_name", "version", "status", "force_status"):
        chunks = chunks.withColumn(c, chunks["standard"])
    asked = spark.createDataFrame([(1, "书库净高是多少", [1.0, 0.1]), (2, "元宇宙展厅", [0.0, 1.0])], "qid int, question string, qvector array<double>")
    got = {r.qid: r for r in ask.ask_batch(chunks, asked, lambda s, u: "见第 1.0.1 条。", k=1, min_run=4).collect()}
    assert got[1].strategy == "keep" and not got[1].refused
    assert got[2].strategy == "refuse" and got[2].refused and not got[2].in_domain
    got = {r.qid: r for r in ask.ask_batch(chunks, asked, None, k=1).collect()}
    assert got[1].strategy == "extractive" and got[1].refused


def test_one_call_a_question(spark, tmp_path):
    """Also without reuse of exchanges, and of a generator that answers differently each time."""
    chunks = spark.createDataFrame([("a", [1.0, 0.0], "书库净高不应小于", "GB 1-2000", "1.0.1", "article")], "id string, embedding array<double>, text string, standard string, article_no string, kind string")
    for c in ("standard_name", "version", "status", "force_status"):
        chunks = chunks.withColumn(c, chunks["standard"])
    asked = spark.createDataFrame([(i, "书库净高", "x") for i in range(12)], "qid int, question string, extra string").repartition(3)

    def chat(system, user):
        import os
        import uuid

        open(os.path.join(tmp_path, uuid.uuid4().hex), "w").close()
        if "七、" not in system:
            raise ValueError
        if len(os.listdir(tmp_path)) % 4 == 0:
            raise ask.ChatError("busy", 429)
        return f"见第 1.0.1 条。{uuid.uuid4().hex}", 7

    settings = ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(c) for c in settings]
    try:
        for c in settings:
            spark.conf.set(c, "false")
        got = ask.ask_batch(chunks, asked, chat, encoder=lambda: lambda texts: [[1.0, 0.0]] * len(texts)).collect()
    finally:
        for c, v in zip(settings, before):
            spark.conf.set(c, v)
    assert len(list(tmp_path.iterdir())) == 12 and len(got) == 12
    for r in got:
        assert (r.strategy, r.tokens) == ("keep", 7) if r.error is None else (r.strategy == "extractive" and "429" in r.error)
    slow = spark.createDataFrame([(1, "s", "u")], "qid int, system string, user string")
    assert "within" in ask.generate(slow, lambda s, u: __import__("time").sleep(3), timeout=0.2).first().error
    requests = spark.createDataFrame([("x", 3), ("", 3), (" ", 3), ("x", 30), (None, None), ("x" * 501, 1)], "question string, top_k int")
    assert [r.status for r in ask.validate(requests).collect()] == [200, 422, 400, 422, 422, 422]
