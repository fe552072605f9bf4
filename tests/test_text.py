from pyspark.sql import functions as F

from clausewright.functions import cited
from clausewright.functions import text as T


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "t string").select(build(F.col("t"))).first()[0]


def test_clause_numbers(spark):
    texts = ["第3.1.6条", "第 3.1.6 条", "3.1.6", "条文 3.1.6 规定", "GB 50352-2019 第 3.1.6 条", "【GB 50352-2019】3.1.6", "（GB 50352—2019）第 3.1.6 条", "3．1．6", "第 3.1.6.条"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.article_numbers(F.col("t"))).collect()
    assert all("3.1.6" in r[0] for r in rows)
    same = {"第3.16条": ["3.16"], "第4.2.4.1款": ["4.2.4.1"], "见附录A": ["附录A"], "见附表 B": ["附录B"], "表4.3.5 规定": ["4.3.5"], "表 4.3.5-1": ["4.3.5"]}
    none = ["2019年发布，2020年1月1日起施行", "净高 2.40m，不小于 2.30m", "藏书量超过 100 万册", "面积 3 平方米", "", None]
    for text, want in [*same.items(), *((t, []) for t in none)]:
        assert one(spark, text, T.article_numbers) == want, text


def test_standards(spark):
    for text, want in {"GB50352-2019": "GB 50352-2019", "gb 50352—2019": "GB 50352-2019", "GB/T 50352-2019": "GB/T 50352-2019", "JGJ38-2015": "JGJ 38-2015", "T 12345": "T 12345", None: ""}.items():
        assert one(spark, text, T.normalize_standard) == want
    assert one(spark, "GB50352", lambda t: T.normalize_standard(t, F.array(F.lit("GB 50352-2019")))) == "GB 50352-2019"
    assert one(spark, "见 GB50352-2019 与gb 1234", T.standards) == ["GB 50352-2019"]


def test_keys(spark):
    for text, want in {"附录 b": "附录B", "4.3.5-表": "4.3.5", "B-1": "附录B", "3-1": "3.1", "表4.2.4-1": "4.2.4", None: ""}.items():
        assert one(spark, text, T.article_key) == want


def test_longest_run(spark):
    rows = [("书库的净高是多少", ["书库的净高不应小于2.40m。"], 2), ("甲乙丙丁", ["甲乙x", "乙丙丁"], 2), ("元宇宙", [], 0), (None, ["x"], 0)]
    found = spark.createDataFrame(rows, "q string, t array<string>, want int").select("want", T.longest_run(F.col("q"), F.col("t"))).collect()
    assert all(r[0] == r[1] for r in found)


def test_sentences_that_come_again_are_read_once(monkeypatch):
    read = []
    numbers = cited.article_numbers
    monkeypatch.setattr(cited, "article_numbers", lambda t: read.append(t) or numbers(t))
    reader = cited.Reader(most=2)
    texts = ["依据【GB50003—2019】第 1.0 条", "见附表 b", "没有"]
    assert [reader.read(t) for t in texts + texts[2:]] == [(["1.0"], ["GB 50003-2019"]), (["附录B"], []), ([], []), ([], [])]
    assert read == texts and len(reader.known) <= 2
    assert cited.article_numbers("1.2.3.4.5条，净高 2.40m，附表 bx，第 ３.1 条") == ["1.2.3.4", "2.3.4.5", "３.1"]


def test_white_space_is_that_of_unicode(spark):
    """And is cut from the ends without a pattern, which took most of the time of hits as lines."""
    points = [c for c in range(1, 0x3100)]
    rows = spark.createDataFrame([(c, chr(c) + "a" + chr(c)) for c in points], "c int, t string")
    got = rows.select("c", T.strip(F.col("t")).alias("s"), F.col("t").rlike(r"(?U)^\s").alias("space"))
    assert all((r.s == "a") == r.space for r in got.collect())
    assert "regexp" not in rows.select(T.strip(F.col("t")))._jdf.queryExecution().toString()
