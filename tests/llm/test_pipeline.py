import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from clausewright.llm.common import stage, table
from clausewright.llm.queries import mix, tokenizer_path

CLASHES = ("_id", "_copies", "_copy", "_gone", "_again", "_quality_score", "_row", "_leak", "copies", "budget", "component_id")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item_id string, kept string, n double, " + ", ".join(f"{c} string" for c in CLASHES)


def test_stages_keep_the_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    before = docs.count()
    for _, step in pipeline.STAGES[:3]:
        out = step(spark, docs, sf).cache()
        assert out.columns == docs.columns
        assert out.count() <= before
        docs, before = out, out.count()
    mixed = pipeline.budget(spark, docs, sf).cache()
    assert mixed.columns == docs.columns and 0 < mixed.count() <= 2 * before
    tokens = pipeline.tokens(spark, mixed, sf)
    assert tokens.count() == mixed.count()


def test_run_on_nulls_repeats_empties_and_clashing_columns(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    item = prose(30)
    texts = {i: prose(60) for i in range(80)}
    texts |= {i: texts[i - 100] + " end" for i in range(100, 110)}  # near copies
    texts |= {i: " ".join(w.upper() + "!!" for w in prose(40).split()) for i in range(200, 260)}  # of low quality
    texts |= {300: prose(40) + " " + item, 301: prose(30_000), 302: None, 303: ""}
    rows = [(i, t, "en", rng.choice(["src0", "src1", None]), 1, "x", "y", 0.5, *[f"{c}{i}" for c in CLASHES]) for i, t in texts.items()]
    rows += [rows[5], rows[5], *[(None, "no id " + texts[1][:200], None, None, None, None, None, None, *CLASHES)] * 3]
    data = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{data}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200 or i >= 300)) for i in texts] + [(None, 1), (7, None)], "doc_id long, quality int").write.parquet(f"{data}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{data}/benchmark.parquet")

    docs, kept = table(spark, data, "documents"), {}
    for name, step in pipeline.STAGES[:4]:
        docs = stage(step(spark, docs, data), f"{data}/{name}")
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        kept[name] = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect())
    assert not {i for i, _ in kept["quality_classifier"]} & set(range(200, 260))
    assert {i for i, _ in kept["minhash_near_dedup"]} == {i for i, _ in kept["quality_classifier"]} - set(range(100, 110))
    assert len(kept["minhash_near_dedup"]) == len(set(kept["minhash_near_dedup"]))  # repeats are gone, those without an id too
    assert {i for i, _ in kept["minhash_near_dedup"]} - {i for i, _ in kept["benchmark_decontamination"]} == {300}
    assert all([r[c] for c in CLASHES] in ([f"{c}{r.doc_id}" for c in CLASHES], list(CLASHES)) for r in docs.select("doc_id", *CLASHES).collect())
    assert set(kept["mixture"]) <= set(kept["benchmark_decontamination"])

    got = pipeline.run(spark, data).orderBy("start").collect()
    model, start = Tokenizer.from_file(tokenizer_path()), 0
    want = []
    for i, t in kept["mixture"]:
        raw = np.array([*model.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
        want.append((i, len(raw) // 4, zlib.crc32(raw)))
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)


def test_run_on_empty_tables(spark, tmp_path):
    data = str(tmp_path)
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{data}/{name}.parquet")
    assert pipeline.run(spark, data).count() == 0


def test_leaves_keep_within_their_budgets(spark, tmp_path):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice("abcdefg") * 3 for _ in range(rng.randint(1, 40)))
    rows = [(rng.choice([None, None, 1, 2, i]), text(), rng.choice(["en", "de", None]), rng.choice(["src0", "src1", None])) for i in range(400)]
    rows += [(None, "one two three four", "en", "src0")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    folder = str(tmp_path)
    planned = {(r.domain, r.lang, r.source): (r.budget, r.whole) for r in mix(docs).groupBy("domain", "lang", "source").agg(F.max("budget").alias("budget"), F.sum(F.col("copies") * F.col("n_tokens")).alias("whole")).collect()}
    out = {}
    for r in stage(pipeline.budget(spark, docs, folder), f"{folder}/mixed").collect():
        leaf = ("crawl" if r.source == "src0" else "curated", r.lang or "", r.source or "")
        out[leaf] = out.get(leaf, 0) + len(r.text.split())
    assert out and all(n <= planned[leaf][0] and n == planned[leaf][1] for leaf, n in out.items())
