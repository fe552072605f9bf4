import threading
import time

import pytest

from clausewright.plans import ask
from clausewright.plans.generation import ChatError, TokenBucket, answers_of, generate, generate_stored


def prompts(spark, n, parts=2):
    return spark.createDataFrame([(i, "rules", f"q{i}", "x") for i in range(n)], "qid int, system string, user string, extra string").repartition(parts)


def test_calls_in_flight_and_late_ones():
    under_way, most, lock = 0, 0, threading.Lock()

    def chat(system, user):
        nonlocal under_way, most
        with lock:
            under_way += 1
            most = max(most, under_way)
        time.sleep(5 if user == "late" else 0.05)
        with lock:
            under_way -= 1
        if user == "bad":
            raise ChatError("no", 429)
        return user.upper(), len(user)

    began = time.monotonic()
    users = [*(f"u{i}" for i in range(12)), "late", "bad"]
    got = dict(answers_of([("s", u) for u in users], chat, 4, 0.8, TokenBucket(None)))
    assert 1 < most <= 4 and time.monotonic() - began < 3
    assert [got[i] for i in range(12)] == [(f"U{i}", len(f"u{i}"), None) for i in range(12)]
    assert got[12] == (None, None, "no answer within 0.8 seconds") and got[13][2].startswith("HTTP 429: wait")
    with pytest.raises(ZeroDivisionError):
        list(answers_of([("s", "u")], lambda s, u: 1 / 0, 2, 1, TokenBucket(None)))


def test_rate():
    bucket, began = TokenBucket(50), time.monotonic()
    for _ in range(11):
        bucket.take()
    assert 0.19 < time.monotonic() - began < 0.6


def test_lanes(spark):
    with pytest.raises(ValueError, match="lanes"):
        generate(prompts(spark, 1), lambda s, u: u, rate=1)
    found = generate(prompts(spark, 9), lambda s, u: u if u != "q3" else None, lanes=3, rate=300)
    assert found.columns == ["qid", "extra", "answer", "tokens", "error"] and found.rdd.getNumPartitions() <= 3
    assert {r.qid: r.answer for r in found.collect()} == {i: f"q{i}" if i != 3 else None for i in range(9)}


def test_a_killed_run_is_resumed(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def chat(system, user):
        with open(calls / user.replace(" ", "_"), "a") as f:
            f.write("x")
        if user == "q5" and not (calls / "mended").exists():
            raise ChatError("busy", 503)
        return f"answer to {user}", 7

    def killed(done):
        if done == 2:
            raise KeyboardInterrupt

    path = str(tmp_path / "answers")
    with pytest.raises(KeyboardInterrupt):
        generate_stored(prompts(spark, 40), chat, path, batch=8, at=killed)
    first = {f.name for f in calls.iterdir()}
    assert 0 < len(first) < 40
    got = generate_stored(prompts(spark, 40), chat, path, batch=8).collect()
    (calls / "mended").write_text("")
    assert len(got) == 40 and all(r.answer == f"answer to q{r.qid}" or (r.qid == 5 and r.error) for r in got)
    assert {f.name: f.read_text() for f in calls.iterdir() if f.name not in ("q5", "mended")} == {f"q{i}": "x" for i in range(40) if i != 5}
    asked = prompts(spark, 40).unionByName(prompts(spark, 40)).withColumn("user", ask.F.when(ask.F.col("qid") == 3, "q3 anew").otherwise(ask.F.col("user")))
    got = {r.qid: r.answer for r in generate_stored(asked, chat, path).collect()}  # a changed prompt and the failed one are asked, no other
    assert got == {i: f"answer to q{i}" if i != 3 else "answer to q3 anew" for i in range(40)}
    assert sum(len(f.read_text()) for f in calls.iterdir()) == 40 + 1 + len((calls / "q5").read_text()) - 1
    assert generate_stored(prompts(spark, 40).limit(0), chat, path).count() == 0


def test_report(spark):
    hits = spark.createDataFrame([(1, 1, 0.5, "规范", "GB 50001-2019", "6.1.1", "现行", "  正文甲乙丙 "), (1, 2, 0.25, None, "GB 50002-2019", "6.1.2", None, None)], "qid int, rank int, score double, standard_name string, standard string, article_no string, status string, text string")
    columns = "qid int, question string, final string, strategy string, degraded boolean, reasons array<string>, coverage double, in_domain boolean, top_score double, used_model boolean, tokens long"
    decided = spark.createDataFrame([(1, "问", "答", "extractive", True, ["一", "二"], 0.0, True, 0.5, False, None), (2, "问二", "无", "refuse", True, [], 0.0, False, None, False, None), (3, None, "见条文", "keep", False, [], 1.0, None, None, True, 12)], columns)
    text = {r.qid: r.text.split("\n") for r in ask.report(decided, hits, 3).collect()}
    rule, line = "=" * 66, "-" * 66
    assert text[1] == [rule, "❓ 问", rule, "💬 答", "", line, "⚠️ 已降级（策略 extractive）：一；二", "🎯 域外判定：域内（top 0.5）", "", line, "📎 检索来源（用于核对条文号，也是「引用」块的内容）：", "  [1] 0.5000  《规范》GB 50001-2019  第 6.1.1 条  ［现行］", "      正文甲", "  [2] 0.2500  《?》GB 50002-2019  第 6.1.2 条  ［］", "      "]
    assert text[2] == [rule, "❓ 问二", rule, "💬 无", "", line, "⚠️ 已降级（策略 refuse）：见上", "🎯 域外判定：域外（top ?）", "", "（检索 0 条 → 未调用大模型，直接拒答）"]
    assert text[3] == [rule, "❓ ", rule, "💬 见条文", "", line, "✅ 引用校验通过（覆盖率 1.0）", "", "（检索 0 条 → 未调用大模型，直接拒答）", "", "（用量：12）"]
