"""Queries over the driver's tables, and the SQL that gives the same rows.

The tables hold no clauses, so three views are derived: chunks from `part`, hits and answers from `lineitem`. The engine
renders and parses the text of citations; the SQL computes the same answer from the integers.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import catalog, citations, corpus, evaluation, policy, predicates, quality_gate, search
from ..operators.inverted_file import InvertedFile
from ..sources.chunks import content_identity, dropped_sections, without_sections
from ..sources.staging import shared_folder
from ..sources.store import row_payload as store_payload
from . import ask

STANDARDS = ("GB 55031-2022", "JGJ 38-2015", "GB 50352-2019", "GB 55037-2022", "GB 99999-2099")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    standard = F.element_at(F.array(*map(F.lit, STANDARDS)), (k % 5 + 1).cast("int"))
    number = _s("6.", k % 9 + 1, ".", k % 7 + 1)
    kind = F.when(F.col("p_size") % 10 == 0, "section").when(F.col("p_size") % 10 == 1, "table").otherwise("article")
    article = F.when(kind == "table", _s(number, "-表")).otherwise(number)
    # Every 13th row has a wrong status, every 29th no text.
    status = F.when(k % 13 == 0, "非强条").otherwise(corpus.force_status(standard, article))
    text = F.when(k % 29 == 0, " ").otherwise(F.col("p_name"))
    return _table(spark, sf_dir, "part").select(k.alias("id"), standard.alias("standard"), F.lit("规范").alias("standard_name"), F.lit("2022").alias("version"), article.alias("article_no"), kind.alias("kind"), F.lit("现行").alias("status"), status.alias("force_status"), text.alias("text"), F.col("p_size").alias("page_start"))


_FORCE = "CASE WHEN standard IN ('GB 55031-2022', 'GB 55037-2022') THEN '全文强制' WHEN standard = 'JGJ 38-2015' THEN CASE WHEN (a = 1 AND b IN (2, 3)) OR (a = 2 AND b IN (1, 2)) THEN '部分强条' ELSE '非强条' END WHEN standard = 'GB 50352-2019' THEN CASE WHEN (a = 7 AND b = 4) OR (a = 8 AND b IN (6, 9)) THEN '原强条已废止' ELSE '非强条' END ELSE 'UNKNOWN' END"
_CHUNKS = f"""c0 AS (SELECT p_partkey AS id, p_partkey % 9 + 1 AS a, p_partkey % 7 + 1 AS b, p_name, p_size AS page_start,
        CASE p_partkey % 5 WHEN 0 THEN 'GB 55031-2022' WHEN 1 THEN 'JGJ 38-2015' WHEN 2 THEN 'GB 50352-2019' WHEN 3 THEN 'GB 55037-2022' ELSE 'GB 99999-2099' END AS standard,
        CASE p_size % 10 WHEN 0 THEN 'section' WHEN 1 THEN 'table' ELSE 'article' END AS kind FROM part),
    c AS (SELECT *, '6.' || a || '.' || b AS base, '6.' || a || '.' || b || CASE WHEN kind = 'table' THEN '-表' ELSE '' END AS article_no, {_FORCE} AS rule_status,
        CASE WHEN id % 13 = 0 THEN '非强条' ELSE {_FORCE} END AS force_status, CASE WHEN id % 29 = 0 THEN ' ' ELSE p_name END AS text FROM c0)"""


#: Rows of `lineitem` in a task, so that a task's memory does not grow with the table.
DEALT = 200_000


def _dealt(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """`rows` dealt by question, once for all that follows: tables of as many rows meet by question where they are."""
    return rows.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / DEALT)), "qid")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each question and clause, ranked by score."""
    k = F.col("l_partkey")
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), k.alias("k"), (F.col("l_discount") * 10).alias("score"))
    rows = _dealt(spark, rows).groupBy("qid", "k").agg(F.max("score").alias("score"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "k")))
    k = F.col("k")
    return rows.select("qid", "k", "rank", "score", _s("GB ", k % 7 + 50003, "-2019").alias("standard"), F.lit("规范").alias("standard_name"), F.lit("2019").alias("version"), _s(k % 3 + 1, ".", k % 2).alias("article_no"), F.lit("article").alias("kind"), F.lit("现行").alias("status"), F.lit("非强条").alias("force_status"), _s("正文", k).alias("text"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence for each line of an order; every fourth names no standard."""
    k, ln = F.col("l_partkey"), F.col("l_linenumber")
    named = F.when(ln % 4 == 0, "").otherwise(_s("【GB", (k + ln % 2) % 7 + 50003, "—2019】"))
    piece = _s("依据", named, "第 ", (k + ln % 3) % 3 + 1, ".", (k + ln % 3) % 2, " 条")
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.struct(ln.alias("ln"), k.alias("k"), piece.alias("piece")).alias("s"))
    return _dealt(spark, rows).groupBy("qid").agg(F.sort_array(F.collect_list("s")).alias("s")).select("qid", F.array_join(F.transform("s", lambda x: x["piece"]), "。").alias("answer"))


_HITS = """h AS (SELECT qid, k, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, k) AS INTEGER) AS rank, k % 7 + 50003 AS std, k % 3 + 1 AS a, k % 2 AS b
        FROM (SELECT l_orderkey AS qid, l_partkey AS k, max(l_discount * 10) AS score FROM lineitem GROUP BY ALL)),
    o AS (SELECT qid, a, b, list_sort(list(DISTINCT std)) AS owners FROM h GROUP BY ALL)"""
_CITES = """s AS (SELECT l_orderkey AS qid, (l_partkey + l_linenumber % 3) % 3 + 1 AS a, (l_partkey + l_linenumber % 3) % 2 AS b,
        CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE (l_partkey + l_linenumber % 2) % 7 + 50003 END AS named FROM lineitem),
    j AS (SELECT s.*, CASE WHEN owners IS NULL THEN 'not_in_hits' WHEN named IS NOT NULL AND NOT list_contains(owners, named) THEN 'standard_mismatch'
        WHEN named IS NULL AND len(owners) > 1 THEN 'ambiguous_article' END AS code FROM s LEFT JOIN o USING (qid, a, b))"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _asked(spark: SparkSession, sf_dir: str, every: int = 20) -> DataFrame:
    return _vectors(spark, sf_dir).filter(F.col("id") % every == 0).select(F.col("id").alias("qid"), F.col("embedding").alias("qvector"), F.col("label").alias("qlabel"))


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


def _topk_sql(where: str = "true", k: int = 5, floor: str = "true", pair: str = "true") -> str:
    return f"""SELECT qid, vec_id, rank, round(score, 6) AS score FROM (
        SELECT q.vec_id AS qid, e.vec_id, {_COS} AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS INTEGER) AS rank
        FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND {pair} AND ({where})) WHERE rank <= {k} AND {floor}"""


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("qid", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


_LABELS = {"in": {"label": {"$in": [1, 2, 3]}}, "ne": {"label": {"$ne": 4}}, "and": {"$and": [{"label": {"$in": [1, 2, 3]}}, {"label": {"$ne": 2}}]}, "or": {"$or": [{"label": 5}, {"label": 7}]}}
_LABEL_SQL = {"in": "e.label IN (1, 2, 3)", "ne": "e.label IS DISTINCT FROM 4", "and": "e.label IN (1, 3)", "or": "e.label IN (5, 7)"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


@query("vector_topk_single", f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_COS} DESC, e.vec_id LIMIT 5")
def vector_topk_single(spark, d):
    vector = _vectors(spark, d).filter("id = 0").first()["embedding"]
    return search.top_k_single(_vectors(spark, d), vector, 5).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query("vector_topk_batch", _topk_sql())
def vector_topk_batch(spark, d):
    return _ranked(search.top_k(_vectors(spark, d), _asked(spark, d), 5, carry_vectors=False))


for _name, _where in _LABELS.items():
    QUERIES[f"vector_topk_filtered_{_name}"] = lambda spark, d, w=_where: _ranked(search.top_k(_vectors(spark, d), _asked(spark, d), 5, w, carry_vectors=False))
    ORACLE_SQL[f"vector_topk_filtered_{_name}"] = _topk_sql(_LABEL_SQL[_name])


@query("min_score_postfilter", _topk_sql(k=10, floor="score >= 0.4"))
def min_score_postfilter(spark, d):
    return _ranked(search.top_k(_vectors(spark, d), _asked(spark, d), 10, min_score=0.4, carry_vectors=False))


@query("self_hit_sample", "SELECT vec_id AS qid, vec_id AS nearest, true AS is_self FROM embeddings ORDER BY vec_id LIMIT 10")
def self_hit_sample(spark, d):
    return search.self_hits(_vectors(spark, d))


@query("indexed_recall", "SELECT count(*) * (SELECT least(10, count(*) - 1) FROM embeddings) AS hits, true AS reached FROM embeddings WHERE vec_id % 20 = 0")
def indexed_recall(spark, d):
    """How many neighbours there are to find for every question, and whether the index finds 95 % of them."""
    rows, asked, folder = _vectors(spark, d), _asked(spark, d), shared_folder(spark)
    index = InvertedFile.build(rows, f"{folder}/index")
    found = index.search(asked, f"{folder}/rounds", 10, others_only=True).select("qid", "id", F.lit(1).alias("found"))
    exact = search.top_k(rows, asked, 10, others_only=True, carry_vectors=False).join(found, ["qid", "id"], "left")
    return exact.agg(F.count(F.lit(1)).alias("hits"), (F.count("found") >= 0.95 * F.count(F.lit(1))).alias("reached"))


_RARE = (3, 50, 77, 101, 222, 333, 444)


@query("indexed_topk_rare", _topk_sql(f"e.vec_id IN {_RARE}", k=10))
def indexed_topk_rare(spark, d):
    """A predicate that leaves fewer rows than k: the search goes on to all cells, and is exact."""
    folder = shared_folder(spark)
    index = InvertedFile.build(_vectors(spark, d), f"{folder}/index")
    return _ranked(index.search(_asked(spark, d), f"{folder}/rounds", 10, {"id": {"$in": list(_RARE)}}))


_IDS = {
    "default_kind_injected": (None, "kind = 'article'"),
    "explicit_kind_kept": ({"kind": "table"}, "kind = 'table'"),
    "force_only_filter": (predicates.force_only(["JGJ 38-2015", "GB 55031-2022"]), "force_status IN ('全文强制', '部分强条') AND kind = 'article' AND standard IN ('JGJ 38-2015', 'GB 55031-2022')"),
    "preset_force_only": (predicates.presets("force-only"), "force_status IN ('全文强制', '部分强条') AND kind = 'article'"),
    "preset_exclude_repealed": (predicates.presets("exclude-repealed", "current"), "force_status <> '原强条已废止' AND kind = 'article'"),
}
for _name, (_where, _sql) in _IDS.items():
    QUERIES[_name] = lambda spark, d, w=_where: chunks(spark, d).filter(predicates.compile_where(predicates.with_default_kind(w))).select("id", "standard", "article_no", "kind")
    ORACLE_SQL[_name] = f"WITH {_CHUNKS} SELECT id, standard, article_no, kind FROM c WHERE {_sql}"


@query("catalog_tally", "SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM documents GROUP BY ALL")
def catalog_tally(spark, d):
    return catalog.tally(_table(spark, d, "documents"), ["lang", "source"])


@query("catalog_counter", f"WITH {_CHUNKS} SELECT standard, force_status, count(*) AS n FROM c GROUP BY ALL")
def catalog_counter(spark, d):
    return catalog.status_counter(chunks(spark, d))


@query("section_filter", f"WITH {_CHUNKS} SELECT id, kind FROM c WHERE kind IS DISTINCT FROM 'section'")
def section_filter(spark, d):
    return without_sections(chunks(spark, d)).select("id", "kind")


@query("text_fingerprint", "SELECT doc_id, sha1(text) AS sha1 FROM documents")
def text_fingerprint(spark, d):
    return _table(spark, d, "documents").select("doc_id", content_identity(F.encode("text", "utf-8")).alias("sha1"))


@query("standard_normalize", "SELECT l_orderkey AS qid, 'GB ' || ((l_partkey + l_linenumber % 2) % 7 + 50003) || '-2019' AS standard, count(*) AS n FROM lineitem WHERE l_linenumber % 4 <> 0 GROUP BY ALL")
def standard_normalize(spark, d):
    pieces = answers(spark, d).select("qid", F.explode(T.sentences(F.col("answer"))).alias("piece"))
    return pieces.select("qid", F.explode(T.standards(F.col("piece"))).alias("standard")).groupBy("qid", "standard").agg(F.count(F.lit(1)).alias("n"))


@query("article_key_normalize", f"WITH {_CHUNKS} SELECT id, base AS key FROM c")
def article_key_normalize(spark, d):
    return chunks(spark, d).select("id", F.explode(T.hit_keys(F.col("article_no"))).alias("key"))


@query("sentence_split", "SELECT conv_id, turn, CAST(sum(CASE WHEN trim(p, ' ' || chr(9) || chr(13)) <> '' THEN 1 ELSE 0 END) AS INTEGER) AS n FROM (SELECT conv_id, turn, unnest(string_split_regex(text, '[。；;\\n]')) AS p FROM conversations) GROUP BY ALL")
def sentence_split(spark, d):
    rows = _table(spark, d, "conversations").select("conv_id", "turn", F.size(T.sentences(F.col("text"))).alias("k"))
    return rows.groupBy("conv_id", "turn").agg(F.sum("k").cast("int").alias("n"))


@query("article_index_max", f"WITH {_HITS} SELECT qid, a || '.' || b AS key, 'GB ' || std || '-2019' AS standard, max(score) AS score FROM h GROUP BY ALL")
def article_index_max(spark, d):
    return citations.article_index(hits(spark, d))


@query("citation_classify", f"WITH {_HITS}, {_CITES} SELECT qid, coalesce(code, 'ok') AS code, count(*) AS n FROM j GROUP BY ALL")
def citation_classify(spark, d):
    judged = citations.classify(citations.cited_clauses(answers(spark, d)), hits(spark, d))
    return judged.groupBy("qid", F.coalesce("code", F.lit("ok")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


_VERDICT = """v AS (SELECT qid, count(code) = 0 AS ok, coalesce(array_to_string(list_sort(list(DISTINCT code)), ','), '') AS codes, count(code) AS faults, count(*) - count(code) AS good,
        round((count(*) - count(code)) / count(*), 4) AS coverage FROM j GROUP BY qid)"""


@query("citation_verify", f"WITH {_HITS}, {_CITES}, {_VERDICT} SELECT qid, ok, codes, CAST(faults AS INTEGER) AS n_unverified, CAST(good AS INTEGER) AS n_cited, coverage FROM v")
def citation_verify(spark, d):
    v = citations.verify(answers(spark, d), hits(spark, d))
    return v.select("qid", "ok", F.array_join(F.sort_array("codes"), ",").alias("codes"), F.size("unverified").alias("n_unverified"), F.size("cited").alias("n_cited"), "coverage")


_REASONS = """w AS (SELECT qid, code, CASE code WHEN 'not_in_hits' THEN '条文号 ' || a || '.' || b || ' 不在本次检索片段里'
        WHEN 'standard_mismatch' THEN '第 ' || a || '.' || b || ' 条出自 ' || array_to_string(list_transform(owners, lambda o: 'GB ' || o || '-2019'), '、') || '，答案却标成 GB ' || named || '-2019'
        ELSE '第 ' || a || '.' || b || ' 条在 ' || array_to_string(list_transform(owners, lambda o: 'GB ' || o || '-2019'), '、') || ' 里都有，答案没有指明出处' END AS reason FROM j LEFT JOIN o USING (qid, a, b) WHERE code IS NOT NULL)"""


@query("citation_reasons", f"WITH {_HITS}, {_CITES}, {_REASONS} SELECT DISTINCT qid, reason FROM w")
def citation_reasons(spark, d):
    return citations.verify(answers(spark, d), hits(spark, d)).select("qid", F.explode("reasons").alias("reason"))


@query("policy_sources", f"WITH {_HITS}, {_CITES}, bad AS (SELECT DISTINCT qid FROM j WHERE code IS NOT NULL) SELECT qid, count(*) AS n FROM j WHERE qid NOT IN (SELECT qid FROM bad) GROUP BY qid UNION ALL SELECT qid, 1 AS n FROM bad")
def policy_sources(spark, d):
    decided, _ = _decided(spark, d)
    return decided.select("qid", F.size("sources").cast("long").alias("n"))


@query("not_in_hits_anti", f"WITH {_HITS}, {_CITES} SELECT qid, a || '.' || b AS key, count(*) AS n FROM j WHERE code = 'not_in_hits' GROUP BY ALL")
def not_in_hits_anti(spark, d):
    rows = citations.not_in_hits(citations.cited_clauses(answers(spark, d)), citations.article_index(hits(spark, d)))
    return rows.groupBy("qid", "key").agg(F.count(F.lit(1)).alias("n"))


@query("extractive_pick", f"WITH {_HITS} SELECT qid, 'GB ' || std || '-2019' AS standard, a || '.' || b AS article_no, '{R.EXTRACT_HEAD}' || chr(10) || '正文' || k || chr(10) || '——出处：《规范》GB ' || std || '-2019 第 ' || a || '.' || b || ' 条' AS extract FROM h WHERE rank = 1")
def extractive_pick(spark, d):
    return policy.extracts(hits(spark, d)).select("qid", "source.standard", "source.article_no", "extract")


@query("policy_strategy", f"WITH {_HITS}, {_CITES}, {_VERDICT} SELECT qid, CASE WHEN ok THEN 'keep' ELSE 'extractive' END AS strategy, NOT ok AS degraded, NOT ok AND qid % 2 = 1 AS refused FROM v")
def policy_strategy(spark, d):
    decided, _ = _decided(spark, d)
    return policy.refused(decided.withColumn("used_model", F.col("qid") % 2 == 0)).select("qid", "strategy", "degraded", "refused")


@query("relevance_stats", f"WITH {_HITS} SELECT qid, count(*) AS n_hits, round(max(score), 4) AS top_score, CAST(CASE qid % 3 WHEN 0 THEN 2 ELSE 0 END AS INTEGER) AS longest_run, qid % 3 = 0 AS in_domain FROM h GROUP BY qid")
def relevance_stats(spark, d):
    found = hits(spark, d)
    asked = F.when(F.col("qid") % 3 == 0, "图书馆正文面积").when(F.col("qid") % 3 == 1, "元宇宙展厅").otherwise("正面文字")
    questions = found.select("qid").distinct().withColumn("question", asked)
    return policy.relevance(questions, found, 2).select("qid", "n_hits", "top_score", "longest_run", "in_domain")


def _ranks(spark, d) -> tuple[DataFrame, DataFrame]:
    asked = _asked(spark, d, 10)
    found = search.top_k(_vectors(spark, d), asked, 10, others_only=True, carry_vectors=False)
    gold = asked.select("qid", F.col("qlabel").alias("label"))
    return found, evaluation.gold_ranks(asked, found, gold, ["label"]).join(asked.select("qid", "qlabel"), "qid")


_RANKS = f"""t AS (SELECT * FROM (SELECT q.vec_id AS qid, q.label AS qlabel, e.label, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank
        FROM embeddings e, embeddings q WHERE q.vec_id % 10 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 10),
    r AS (SELECT qid, qlabel, CAST(min(rank) FILTER (label = qlabel) AS INTEGER) AS best_rank, max(score) FILTER (label = qlabel) AS gold_score FROM t GROUP BY ALL)"""
_SHARE = "avg(CASE WHEN best_rank <= {k} THEN 1.0 ELSE 0.0 END)"


@query("recall_at_k", f"WITH {_RANKS} SELECT count(*) AS n, " + ", ".join(f"round({_SHARE.format(k=k)}, 9) AS recall_{k}" for k in (1, 3, 5, 10)) + " FROM r")
def recall_at_k(spark, d):
    out = evaluation.recall_at(_ranks(spark, d)[1])
    return out.select("n", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


_GOLD = """g AS (SELECT DISTINCT l_orderkey AS qid, (l_partkey + l_linenumber % 2) % 7 + 50003 AS std, l_partkey % 3 + 1 AS a, l_partkey % 2 AS b FROM lineitem WHERE l_linenumber <= 2)"""


@query("gold_on_two_keys", f"WITH {_HITS}, {_GOLD}, q AS (SELECT DISTINCT qid FROM h), f AS (SELECT h.qid, min(h.rank) AS best_rank, max(h.score) AS gold_score FROM h JOIN g USING (qid, std, a, b) GROUP BY h.qid) SELECT qid, best_rank, gold_score FROM q LEFT JOIN f USING (qid)")
def gold_on_two_keys(spark, d):
    """Gold clauses by standard and number: one with the right number in another standard is none."""
    k, ln = F.col("l_partkey"), F.col("l_linenumber")
    gold = _table(spark, d, "lineitem").filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("qid"), _s("GB ", (k + ln % 2) % 7 + 50003, "-2019").alias("standard"), _s(k % 3 + 1, ".", k % 2).alias("article_no"))
    found = hits(spark, d)
    return evaluation.gold_ranks(found.select("qid").distinct(), found, gold, ["standard", "article_no"])


@query("mrr", f"WITH {_RANKS} SELECT round(avg(coalesce(1.0 / best_rank, 0.0)), 9) AS mrr FROM r")
def mrr(spark, d):
    return evaluation.mean_reciprocal_rank(_ranks(spark, d)[1]).select(F.round("mrr", 9).alias("mrr"))


@query("rank_distribution", f"WITH {_RANKS} SELECT best_rank, count(*) AS n FROM r GROUP BY ALL")
def rank_distribution(spark, d):
    return evaluation.rank_distribution(_ranks(spark, d)[1])


@query("score_percentile", f"WITH {_RANKS} SELECT round(quantile_cont(gold_score, 0.05), 6) AS low_gold, round((SELECT max(score) FROM t WHERE label <> qlabel), 6) AS top_negative FROM r")
def score_percentile(spark, d):
    found, ranks = _ranks(spark, d)
    negatives = found.filter(F.col("label") != F.col("qlabel"))
    return evaluation.threshold_window(ranks, negatives).select(F.round("low_gold", 6).alias("low_gold"), F.round("top_negative", 6).alias("top_negative"))


@query("threshold_sweep", f"WITH {_RANKS} SELECT CAST(th AS DOUBLE) AS threshold, count(*) FILTER (label <> qlabel AND score >= th) AS negatives_over, count(*) FILTER (label = qlabel AND score < th) AS positives_under FROM t, (VALUES (0.2), (0.3), (0.4), (0.5)) x(th) GROUP BY ALL")
def threshold_sweep(spark, d):
    found, _ = _ranks(spark, d)
    return evaluation.threshold_sweep(found.withColumn("positive", F.col("label") == F.col("qlabel")), [0.2, 0.3, 0.4, 0.5])


_JUDGED = f"""WITH {_RANKS}, c AS (SELECT round(score, 6) AS threshold, count(*) FILTER (label = qlabel) AS p, count(*) FILTER (label <> qlabel) AS n FROM t GROUP BY ALL),
    curve AS (SELECT threshold, CAST(sum(n) OVER (ORDER BY threshold ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS negatives_over,
        CAST(coalesce(sum(p) OVER (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS positives_under FROM c)"""


def _curve(spark, d):
    found, _ = _ranks(spark, d)
    return evaluation.threshold_curve(found.select(F.round("score", 6).alias("score"), (F.col("label") == F.col("qlabel")).alias("positive")), f"{shared_folder(spark)}/ranges")


@query("threshold_curve", _JUDGED + " SELECT threshold, negatives_over, positives_under, negatives_over + positives_under AS errors FROM curve")
def threshold_curve(spark, d):
    return _curve(spark, d)


@query("threshold_best", _JUDGED + " SELECT threshold, negatives_over, positives_under, negatives_over + positives_under AS errors FROM curve ORDER BY errors, threshold LIMIT 1")
def threshold_best(spark, d):
    return evaluation.best_cut(_curve(spark, d))


@query("score_percentile_sketch", "SELECT qlabel, n, true AS within FROM (SELECT label AS qlabel, count(*) AS n FROM embeddings GROUP BY label UNION ALL SELECT NULL, count(*) FROM embeddings)")
def score_percentile_sketch(spark, d):
    """The low percentile of the first component by label and over all, from sketches of finer slices, and whether its rank is right to 2 %."""
    rows = _vectors(spark, d).select(F.col("label").alias("qlabel"), (F.col("id") % 7).alias("part"), F.get("embedding", 0).cast("double").alias("gold_score"))
    stored = evaluation.score_sketches(rows, ["qlabel", "part"])
    low = evaluation.sketched_percentile(stored, ["qlabel"]).unionByName(evaluation.sketched_percentile(stored.withColumn("qlabel", F.lit(None).cast("int")), ["qlabel"]))
    every = rows.unionByName(rows.withColumn("qlabel", F.lit(None).cast("int")))
    placed = every.join(F.broadcast(low.withColumnRenamed("qlabel", "of").drop("n")), F.col("qlabel").eqNullSafe(F.col("of")))  # a row for each label
    shares = placed.groupBy("qlabel").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gold_score") < F.col("low")).cast("int")).alias("below"), F.avg((F.col("gold_score") <= F.col("low")).cast("int")).alias("upto"))
    return shares.select("qlabel", "n", ((F.col("below") - 0.02 <= 0.05) & (F.col("upto") + 0.02 >= 0.05)).alias("within"))


@query("eval_slices", f"WITH {_RANKS} SELECT CASE WHEN grouping(qlabel) = 0 THEN 'qlabel' WHEN grouping(half) = 0 THEN 'half' ELSE 'all' END AS slice, qlabel, half, count(*) AS n, round({_SHARE.format(k=1)}, 9) AS recall FROM (SELECT *, qid % 20 AS half FROM r) GROUP BY GROUPING SETS ((qlabel), (half), ())")
def eval_slices(spark, d):
    out = evaluation.slices(_ranks(spark, d)[1].withColumn("half", F.col("qid") % 20), ["qlabel", "half"])
    return out.select("slice", "qlabel", "half", "n", F.round("recall", 9).alias("recall"))


@query("precision_at_rank_map", f"WITH {_RANKS}, p AS (SELECT qid, label = qlabel AS good, sum(CASE WHEN label = qlabel THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank) / rank AS p FROM t) SELECT qid, round(coalesce(avg(p) FILTER (good), 0.0), 9) AS context_precision FROM p GROUP BY qid")
def precision_at_rank_map(spark, d):
    found, _ = _ranks(spark, d)
    out = evaluation.context_precision(found.withColumn("relevant", F.col("label") == F.col("qlabel")))
    return out.select("qid", F.round("context_precision", 9).alias("context_precision"))


@query("force_status_distribution", f"WITH {_CHUNKS} SELECT standard, rule_status AS status, count(*) AS n FROM c GROUP BY ALL")
def force_status_distribution(spark, d):
    rows = chunks(spark, d).select("standard", corpus.force_status(F.col("standard"), F.col("article_no")).alias("status"))
    return rows.groupBy("standard", "status").agg(F.count(F.lit(1)).alias("n"))


_LISTED_SQL = "l(standard, base, force_status) AS (VALUES " + ", ".join(f"('{s}', '{a}', '{status}')" for s, status, articles in R.LISTED for a in articles) + ")"


@query("listed_missing", f"WITH {_CHUNKS}, {_LISTED_SQL} SELECT standard, base AS article_no, force_status FROM l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.standard = l.standard AND c.base = l.base)")
def listed_missing(spark, d):
    return corpus.listed_missing(chunks(spark, d))


@query("quality_gate", f"""WITH {_CHUNKS}, {_LISTED_SQL}, g AS (
    SELECT 'section_rows' AS "check", count(*) FILTER (kind = 'section') AS failures FROM c UNION ALL SELECT 'force_status', count(*) FILTER (force_status <> rule_status) FROM c
    UNION ALL SELECT 'blank_text', count(*) FILTER (trim(text) = '') FROM c UNION ALL SELECT 'short_text', count(*) FILTER (kind = 'article' AND trim(text) <> '' AND length(trim(text)) < 10) FROM c
    UNION ALL SELECT 'listed_missing', count(*) FROM l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.standard = l.standard AND c.base = l.base))
    SELECT "check", failures, CASE WHEN failures = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM g""")
def gate(spark, d):
    return quality_gate.gate(chunks(spark, d))


@query("render_context", f"WITH {_HITS} SELECT qid, string_agg('【片段 ' || rank || '】【规范 GB ' || std || '-2019（2019）】条文号 ' || a || '.' || b || ' ［现行；非强条］' || chr(10) || '正文' || k, chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY qid")
def render_context(spark, d):
    return ask.render(hits(spark, d))


@query("hit_projection", f"WITH {_HITS} SELECT qid, rank, a || '.' || b AS article_no, 'GB ' || std || '-2019' AS standard, '' AS page, '' AS chapter, '正文' || k AS text, round(score, 4) AS score FROM h")
def hit_projection(spark, d):
    return search.hit_projection(hits(spark, d)).select("qid", "rank", "article_no", "standard", "page", "chapter", "text", "score")


@query("numeric_key_extract", r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '([0-9]{1,2}(?:\s*[.．]\s*[0-9]{1,3}){1,3})(?:\s*-\s*[0-9]{1,2})?', 1)) AS key FROM documents")
def numeric_key_extract(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.bare_numbers(F.col("text")))).alias("key"))


_RUN_SQL = "SELECT p_partkey AS id, CAST(CASE WHEN greatest(p_partkey % 5, p_partkey % 4) >= 2 THEN greatest(p_partkey % 5, p_partkey % 4) ELSE 0 END AS INTEGER) AS run FROM part"


@query("longest_run", _RUN_SQL)
def longest_run(spark, d):
    """The first half of the question is in one text with k % 5 of its characters, the second in another with k % 4."""
    k = F.col("p_partkey")
    left, right = F.lit("甲乙丙丁"), F.lit("戊己庚辛")
    texts = F.array(F.concat(F.lit("书"), F.substring(left, F.lit(1), (k % 5).cast("int")), F.col("p_name")), F.concat(F.substring(right, F.lit(2), (k % 4).cast("int")), F.lit("库")))
    rows = _table(spark, d, "part").select(k.alias("id"), F.concat(left, right, F.lit("？")).alias("question"), texts.alias("texts"))
    return rows.select("id", T.longest_run(F.col("question"), F.col("texts")).alias("run"))


_SPLIT_SQL = """WITH p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    l AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS i, unnest(parts) AS x FROM p),
    n AS (SELECT doc_id, i, '6.' || (i // 3 // 900 + 1) || '.' || (i // 3 % 900 + 1) AS num, x FROM l)
    SELECT doc_id, num AS article_no, string_agg(CASE WHEN i % 3 = 0 THEN num || ' ' ELSE '段' END || x || '。', chr(10) ORDER BY i) AS text,
        CAST(min(i) // 4 + 1 AS INTEGER) AS page_start, CAST(max(i) // 4 + 1 AS INTEGER) AS page_end FROM n GROUP BY doc_id, num"""


@query("clause_split", _SPLIT_SQL)
def clause_split(spark, d):
    """Every document as a standard: front matter, a page mark before each fourth line, a clause in each third, explanations behind."""

    def marked(x: Column, i: Column) -> Column:
        group = F.floor(i / 3)
        number = _s("6.", F.floor(group / 900) + 1, ".", group % 900 + 1, " ")
        line = F.concat(F.when(i % 3 == 0, number).otherwise("段"), x, F.lit("。"))
        page = F.when(i % 4 == 0, F.array(_s("<!-- page ", F.floor(i / 4) + 1, " -->"))).otherwise(F.array().cast("array<string>"))
        return F.concat(page, F.array(line))

    body = F.flatten(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), marked))
    whole = F.concat(F.array(F.lit("前言"), F.lit("条文说明"), F.lit("6 总则")), body, F.array(F.lit("7 附则"), F.lit("条 文 说 明"), F.lit("6.1.1 说明")))
    lines = _table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(whole).alias("line", "text"))
    return corpus.split_clauses(lines).withColumnRenamed("file", "doc_id")


_PAGES_SQL = """WITH p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    l AS (SELECT doc_id, len(parts) AS n, generate_subscripts(parts, 1) - 1 AS i, unnest(parts) AS x FROM p),
    m AS (SELECT doc_id, i, 0 AS half, '3.' || (i // 5 // 900 + 1) || '.' || (i // 5 % 900 + 1) AS num, CASE WHEN i % 5 = 0 THEN '3.' || (i // 5 // 900 + 1) || '.' || (i // 5 % 900 + 1) || ' ' ELSE '段' END || x || '。' AS t FROM l
        UNION ALL SELECT doc_id, i, 1, '3.' || (i // 5 // 900 + 1) || '.' || (i // 5 % 900 + 1), CAST(i % 1000 AS VARCHAR) FROM l WHERE i % 3 = 0 AND i % 4 <> 3 AND i < n - 1)
    SELECT doc_id, num AS article_no, string_agg(t, chr(10) ORDER BY i, half) AS text, CAST(min(i) // 4 + 1 AS INTEGER) AS page_start, CAST(max(i) // 4 + 1 AS INTEGER) AS page_end FROM m GROUP BY doc_id, num"""


@query("page_footers", _PAGES_SQL)
def page_footers(spark, d):
    """A bare number behind every third line of a document, of which those that end a page are footers."""

    def marked(x: Column, i: Column) -> Column:
        group = F.floor(i / 5)
        line = F.concat(F.when(i % 5 == 0, _s("3.", F.floor(group / 900) + 1, ".", group % 900 + 1, " ")).otherwise("段"), x, F.lit("。"))
        page = F.when(i % 4 == 0, F.array(_s("<!-- page ", F.floor(i / 4) + 1, " -->"))).otherwise(F.array().cast("array<string>"))
        return F.concat(page, F.array(line), F.when(i % 3 == 0, F.array((i % 1000).cast("string"))).otherwise(F.array().cast("array<string>")))

    body = F.flatten(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), marked))
    lines = _table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(body).alias("line", "text"))
    return corpus.split_clauses(lines).withColumnRenamed("file", "doc_id")


_FORMS = """CASE p_partkey % 6 WHEN 0 THEN a || '.' || b || '.' || c WHEN 1 THEN a || '.' || b || '.' || c WHEN 4 THEN '附录' || chr(CAST(65 + p_partkey % 8 AS INTEGER)) WHEN 5 THEN a || '.' || b ELSE NULL END"""


@query("article_number_forms", f"SELECT * FROM (SELECT p_partkey AS id, {_FORMS} AS key FROM (SELECT p_partkey, p_partkey % 9 + 1 AS a, p_partkey % 7 + 1 AS b, p_partkey % 40 + 1 AS c FROM part)) WHERE key IS NOT NULL")
def article_number_forms(spark, d):
    """Labelled and bare numbers, quantities, years and standards (which are none), appendices, tables."""
    k = F.col("p_partkey")
    a, b, c = k % 9 + 1, k % 7 + 1, k % 40 + 1
    forms = (_s("依第 ", a, ".", b, ".", c, " 条"), _s("见 ", a, ".", b, ".", c), _s("净高 ", a, ".", b, "m"), _s(k % 60 + 1960, "年发布的 GB ", k % 900 + 50000, "-2019"), _s("见附录", F.char(k % 8 + 65)), _s("按表 ", a, ".", b, "-1 取值"))
    text = F.element_at(F.array(*forms), (k % 6 + 1).cast("int"))
    return _table(spark, d, "part").select(k.alias("id"), F.explode(T.article_numbers(text)).alias("key"))


_FAULT_CODES = ("empty_answer", "model_refused", "no_citation", "ambiguous_article", "", "not_in_hits", "standard_mismatch")


@query("answer_faults", "SELECT p_partkey AS qid, CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_FAULT_CODES)) + " END AS codes, CASE WHEN p_partkey % 7 IN (1, 4) THEN 1.0 ELSE 0.0 END::DOUBLE AS coverage, CASE p_partkey % 7 WHEN 1 THEN 'refuse' WHEN 4 THEN 'keep' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'extractive' ELSE 'refuse' END END AS strategy FROM part")
def answer_faults(spark, d):
    """Each fault of a whole answer and of a citation; every second question has no clause that could be quoted."""
    k = F.col("p_partkey")
    texts = [F.when(k % 2 == 0, " "), F.lit(R.REFUSAL + "。"), F.lit("没有条文。"), F.lit("见第 6.1.1 条。"), F.lit("【GB 50001-2019】第 6.1.1 条。"), F.lit("【GB 50001-2019】第 9.9.9 条。"), F.lit("【GB 50003-2019】第 6.1.1 条。")]
    asked = _table(spark, d, "part").select(k.alias("qid"), F.element_at(F.array(*texts), (k % 7 + 1).cast("int")).alias("answer"))
    standard = F.posexplode(F.array(F.lit("GB 50001-2019"), F.lit("GB 50002-2019"))).alias("rank", "standard")
    found = asked.select("qid", standard).select("qid", "rank", "standard", F.lit("6.1.1").alias("article_no"), F.lit("").alias("standard_name"), F.lit("article").alias("kind"), F.lit(0.5).alias("score"), F.when(F.col("qid") % 2 == 0, "正文").alias("text"))
    decided = policy.apply_policy(citations.verify(asked, found), policy.extracts(found))
    return decided.select("qid", F.array_join("codes", ",").alias("codes"), "coverage", "strategy")


@query("standards_without_rules", f"WITH {_CHUNKS} SELECT DISTINCT standard FROM c WHERE rule_status = 'UNKNOWN'")
def standards_without_rules(spark, d):
    return corpus.without_rules(chunks(spark, d))


@query("dropped_section_count", f"WITH {_CHUNKS} SELECT count(*) FILTER (kind = 'section') AS dropped FROM c")
def dropped_section_count(spark, d):
    return dropped_sections(chunks(spark, d))


@query("untraced_contexts", "SELECT c.doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || '。' ELSE text END AS text FROM documents) c WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.text = c.text)")
def untraced_contexts(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    cut = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("。"))).otherwise(F.col("text"))
    return corpus.untraced(docs.select("doc_id", cut.alias("text")), docs).select("doc_id")


@query("request_validation", "SELECT conv_id, turn, top_k, CAST(CASE WHEN length(q) < 1 OR length(q) > 500 OR coalesce(top_k, 0) < 0 OR coalesce(top_k, 0) > 20 THEN 422 WHEN trim(q, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 400 ELSE 200 END AS INTEGER) AS status, count(*) AS n FROM (SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN '  ' || chr(10) WHEN conv_id % 13 = 0 THEN '' ELSE coalesce(text, '') END AS q, CASE WHEN conv_id % 7 <> 6 THEN CAST(conv_id % 25 - 2 AS INTEGER) END AS top_k FROM conversations) GROUP BY ALL")
def request_validation(spark, d):
    """Every turn of a conversation as a request, of which some are blank or out of bounds."""
    c = F.col("conv_id")
    text = F.when(c % 11 == 0, "  \n").when(c % 13 == 0, "").otherwise(F.col("text"))
    asked = _table(spark, d, "conversations").select("conv_id", "turn", text.alias("question"), F.when(c % 7 != 6, (c % 25 - 2).cast("int")).alias("top_k"))
    return ask.validate(asked).groupBy("conv_id", "turn", "top_k", "status").agg(F.count(F.lit(1)).alias("n"))


@query("hit_preview", f"WITH {_HITS}, t AS (SELECT *, rtrim(repeat('正文' || k || ' ', CAST(k % 60 AS INTEGER))) AS t FROM h) SELECT qid, string_agg('[' || rank || '] 相似度 ' || printf('%.4f', CAST(score AS DOUBLE)) || chr(10) || '    《规范》GB ' || std || '-2019  第 ' || a || '.' || b || ' 条  ［现行；非强条］' || chr(10) || '    ' || substr(t, 1, 200) || CASE WHEN length(t) > 200 THEN '…' ELSE '' END, chr(10) ORDER BY rank) AS text FROM t GROUP BY qid")
def hit_preview(spark, d):
    """Hits as lines for a terminal, long texts cut."""
    long = F.repeat(_s("正文", F.col("k"), " "), (F.col("k") % 60).cast("int"))
    return ask.shown(hits(spark, d).withColumn("text", long))


@query("text_truncation", "SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '……' ELSE text END AS short FROM documents")
def text_truncation(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.shortened(F.col("text")).alias("short"))


@query("secret_mask", "SELECT doc_id, CASE WHEN secret IS NULL OR secret = '' THEN '(未设置)' WHEN length(secret) <= 10 THEN substr(secret, 1, 2) || repeat('*', greatest(length(secret) - 2, 0)) ELSE substr(secret, 1, 3) || '…' || right(secret, 4) || '（长度 ' || length(secret) || '）' END AS shown FROM (SELECT doc_id, CASE WHEN doc_id % 31 <> 0 THEN substr(text, 1, CAST(doc_id % 25 AS INTEGER)) END AS secret FROM documents)")
def secret_mask(spark, d):
    k = F.col("doc_id")
    secret = F.when(k % 31 != 0, F.substring(F.col("text"), F.lit(1), (k % 25).cast("int")))
    return _table(spark, d, "documents").select("doc_id", T.mask(secret).alias("shown"))


@query("chat_messages", f"WITH {_HITS} SELECT qid, length(system) > 0 AS has_rules, user FROM (SELECT qid, 'x' AS system, '【检索片段】' || chr(10) || string_agg('【片段 ' || rank || '】【规范 GB ' || std || '-2019（2019）】条文号 ' || a || '.' || b || ' ［现行；非强条］' || chr(10) || '正文' || k, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || '【用户问题】' || chr(10) || '问题' || qid AS user FROM h GROUP BY qid)")
def chat_messages(spark, d):
    found = hits(spark, d)
    questions = found.select("qid").distinct().withColumn("question", _s("问题", F.col("qid")))
    return ask.messages(questions, ask.render(found)).select("qid", (F.length("system") > 0).alias("has_rules"), "user")


def _decided(spark, d) -> tuple[DataFrame, DataFrame]:
    found = hits(spark, d)
    decided = policy.apply_policy(citations.verify(answers(spark, d), found), policy.extracts(found))
    return decided, found


@query("decision_summary", f"WITH {_HITS}, {_CITES}, {_VERDICT} SELECT qid, ok, CAST(good AS INTEGER) AS n_cited, CAST(faults AS INTEGER) AS n_unverified, coverage, CASE WHEN ok THEN 'keep' ELSE 'extractive' END AS strategy, NOT ok AS degraded FROM v")
def decision_summary(spark, d):
    told = policy.summarize(_decided(spark, d)[0])
    return told.select("qid", "ok", F.size("cited").alias("n_cited"), F.size("unverified").alias("n_unverified"), "coverage", "strategy", "degraded")


_REPORT_SQL = f"""WITH {_HITS}, {_CITES}, {_VERDICT}, l AS (SELECT qid, count(*) AS n, string_agg('  [' || rank || '] ' || printf('%.4f', CAST(score AS DOUBLE)) || '  《规范》GB ' || std || '-2019  第 ' || a || '.' || b || ' 条  ［现行］' || CASE WHEN qid % 2 = 0 THEN '' ELSE chr(10) || '      正文' || k END, chr(10) ORDER BY rank) AS lines FROM h GROUP BY qid)
    SELECT qid, repeat('=', 66) || chr(10) || '❓ 问题' || qid || chr(10) || repeat('=', 66) AS head, ok, CASE WHEN ok THEN '✅ 引用校验通过（覆盖率 1.0）' ELSE '⚠️ 已降级（策略 extractive）：' END AS verdict, repeat('-', 66) || chr(10) || '📎 检索来源（用于核对条文号，也是「引用」块的内容）：' || chr(10) || lines || CASE WHEN qid % 3 = 0 THEN '' ELSE chr(10) || chr(10) || '（用量：' || qid || '）' END AS sources FROM v JOIN l USING (qid)"""


@query("result_report", _REPORT_SQL)
def result_report(spark, d):
    """Whole results as a client shows them, cut apart again: the head, the verdict up to its reasons, the sources."""
    decided, found = _decided(spark, d)
    q = F.col("qid")
    asked = decided.withColumn("question", _s("问题", q)).withColumn("used_model", q % 2 == 0).withColumn("tokens", F.when(q % 3 != 0, q))
    text = F.col("text")
    told = ask.report(asked, found, also=("ok",))
    rule = "\n" + "-" * 66 + "\n"
    parts = F.split(text, rule)
    head = F.substring_index(F.get(parts, 0), "\n💬 ", 1)
    verdict = F.regexp_extract(F.element_at(parts, -2), "^(⚠️ 已降级（策略 [a-z]+）：|✅[^\\n]*)", 1)
    return told.select("qid", head.alias("head"), "ok", verdict.alias("verdict"), F.concat(F.lit("-" * 66 + "\n"), F.element_at(parts, -1)).alias("sources"))


@query("gate_exit_code", f"""WITH {_CHUNKS}, {_LISTED_SQL} SELECT CAST(CASE WHEN (SELECT count(*) FROM c WHERE kind = 'section' OR force_status <> rule_status OR trim(text) = '' OR (kind = 'article' AND length(trim(text)) < 10)) > 0
    OR EXISTS (SELECT 1 FROM l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.standard = l.standard AND c.base = l.base)) THEN 1 ELSE 0 END AS INTEGER) AS exit_code""")
def gate_exit_code(spark, d):
    return quality_gate.exit_code(quality_gate.gate(chunks(spark, d)))


@query("row_payload", f"WITH {_CHUNKS} SELECT id, text, standard AS standard, article_no AS article_no, CASE WHEN kind = 'table' THEN '' ELSE kind END AS kind, page_start FROM c")
def row_payload(spark, d):
    """What a store keeps of a clause, by a cleaner that empties missing kinds."""
    rows = chunks(spark, d).withColumn("kind", F.when(F.col("kind") != "table", F.col("kind")))
    kept = store_payload(rows, lambda name, column: F.coalesce(column, F.lit("")) if name == "kind" else column)
    return kept.select("id", "text", "meta.standard", "meta.article_no", "meta.kind", "meta.page_start")
