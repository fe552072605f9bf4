"""Batches of questions: retrieve, render, generate, verify, decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import rules as R
from ..functions.text import shortened, strip
from ..operators.citations import verify
from ..operators.policy import apply_policy, extracts, refused, relevance
from ..operators.inverted_file import InvertedFile
from ..operators.predicates import Where, with_default_kind
from ..operators.search import top_k
from ..sources.staging import shared_folder, staged
from .generation import ChatError, generate, generate_stored

__all__ = ["ChatError", "RULES", "ask_batch", "encode", "generate", "messages", "render", "report", "shown", "validate"]

#: What the generator is told.
RULES = "\n".join(
    (
        "你只能依据【检索片段】回答建筑规范问题。",
        "一、片段以外的知识、经验和推测一律不用。",
        "二、每个结论都写明出处，形如【GB 50352-2019】2.0.16。",
        "三、条文号必须逐字见于片段，不推断、不拼接、不补全。",
        "四、片段与问题无关时，只答：本知识库未收录该内容。",
        "五、片段缺少具体数值时，说明该数值在收录内容中缺失。",
        "六、不同规范的条文不合并成一条。",
        "七、图示、设备型号等未覆盖的内容，说明未收录。",
    )
)


def validate(requests: DataFrame) -> DataFrame:
    """`requests` (question, top_k) with status: 422 outside the bounds (1 to 500 characters, 0 to 20 rows), 400 if blank, else 200. 0 rows mean the default."""
    size = F.length(F.coalesce("question", F.lit("")))
    bad = (size < 1) | (size > 500) | (F.coalesce("top_k", F.lit(0)) < 0) | (F.coalesce("top_k", F.lit(0)) > 20)
    return requests.withColumn("status", F.when(bad, 422).when(strip(F.col("question")) == "", 400).otherwise(200))


def render(hits: DataFrame) -> DataFrame:
    """(qid, context): the hits of each question as numbered passages with their origin, in rank order."""
    named = lambda c, missing: F.coalesce(F.col(c), F.lit(missing))
    head = F.concat(F.lit("【片段 "), F.col("rank").cast("string"), F.lit("】【"), named("standard_name", "?"), F.lit(" "), named("standard", "?"), F.lit("（"), named("version", "?"), F.lit("）】条文号 "), named("article_no", "?"), F.lit(" ［"), named("status", ""), F.lit("；"), named("force_status", ""), F.lit("］"))
    passage = F.concat(head, F.lit("\n"), strip(named("text", "")), F.lit("\n"))
    rows = hits.select("qid", F.struct("rank", passage.alias("p")).alias("x")).groupBy("qid").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return rows.select("qid", strip(F.array_join(F.transform("xs", lambda x: x["p"]), "\n")).alias("context"))


def messages(questions: DataFrame, context: DataFrame) -> DataFrame:
    """(qid, system, user) for the generator."""
    user = F.concat(F.lit("【检索片段】\n"), F.coalesce("context", F.lit("")), F.lit("\n\n【用户问题】\n"), F.col("question"))
    return questions.join(context, "qid", "left").select("qid", F.lit(RULES).alias("system"), user.alias("user"))


def encode(questions: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """`questions` with `qvector`, by an injected encoder: `encoder()` loads it, once for each task, and it takes texts batch by batch. A null question counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_vectors = encoder()
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("question")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to_vectors(texts), pa.list_(pa.float64()))], [*batch.schema.names, "qvector"])

    base = questions.drop("qvector")
    return base.mapInArrow(run, StructType([*base.schema.fields, StructField("qvector", ArrayType(DoubleType()))]))


def ask_batch(chunks: DataFrame, questions: DataFrame, chat: Callable[[str, str], str | tuple[str, int]] | None, k: int = 5, where: Where | None = None, min_score: float | None = None, min_run: int = 0, encoder: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None, timeout: float = 90, answers_path: str | None = None, index: InvertedFile | None = None, **calls) -> DataFrame:
    """(qid, final, strategy, degraded, refused, codes, reasons, sources, coverage, in_domain, tokens, error) for `questions` (qid, question, and qvector unless an encoder is given).

    Questions without hits or out of domain do not reach the generator; without a generator (`chat` None) no answer is made.
    Hits and answers are written to the shared folder before they are verified: the generator is called once for each question,
    and what is verified is what is returned, also where an executor is lost. A call that fails leaves an empty answer. With
    `index`, an inverted file of the chunks, hits are approximate. With
    `answers_path`, answers are kept there, and a batch that is asked again calls the generator only for what has none (see
    generate_stored()); `calls` are the bounds of generate().
    """
    folder = shared_folder(chunks.sparkSession)
    if encoder is not None:
        questions = staged(encode(questions, encoder), f"{folder}/questions")
    wanted = questions.select("qid", "qvector")
    if index is None:
        found = top_k(chunks, wanted, k, with_default_kind(where), min_score, carry_vectors=False)
    else:
        found = index.search(wanted, f"{folder}/rounds", k, with_default_kind(where), min_score)
    hits = staged(found, f"{folder}/hits")
    relevant = relevance(questions, hits, min_run)
    open_questions = questions.join(relevant.filter("in_domain").select("qid"), "qid", "left_semi")
    no_answer = (F.lit(None).cast("string").alias("answer"), F.lit(None).cast("long").alias("tokens"), F.lit(None).cast("string").alias("error"))
    if chat is None:
        made = open_questions.select("qid", *no_answer)
    elif answers_path is None:
        made = generate(messages(open_questions, render(hits)), chat, timeout, **calls)
    else:
        made = generate_stored(messages(open_questions, render(hits)), chat, answers_path, timeout=timeout, **calls)
    made = staged(made, f"{folder}/answers")
    answers = questions.select("qid").join(made, "qid", "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    decided = apply_policy(verify(answers, hits), extracts(hits), relevant)
    flagged = refused(decided.withColumn("used_model", F.coalesce("in_domain", F.lit(False)) & F.lit(chat is not None)))
    flagged = flagged.join(made.select("qid", "tokens", "error"), "qid", "left")
    return flagged.select("qid", "final", "strategy", "degraded", "refused", "codes", "reasons", "sources", "coverage", "in_domain", "tokens", "error")


def shown(hits: DataFrame, most: int = 200) -> DataFrame:
    """(qid, text): the hits of each question as lines for a terminal, texts cut to `most` characters."""
    named = lambda c, missing: F.coalesce(F.col(c), F.lit(missing))
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] 相似度 "), F.format_string("%.4f", F.col("score").cast("double")), F.lit("\n    《"), named("standard_name", "?"), F.lit("》"), named("standard", "?"), F.lit("  第 "), named("article_no", "?"), F.lit(" 条  ［"), named("status", ""), F.lit("；"), named("force_status", ""), F.lit("］\n    "), shortened(F.replace(strip(named("text", "")), F.lit("\n"), F.lit(" ")), most, "…"))
    rows = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return rows.select("qid", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))


def report(decided: DataFrame, hits: DataFrame, most: int = 180, also: tuple[str, ...] = ()) -> DataFrame:
    """(qid, columns of `decided` in `also`, text): each result as a client shows it. `decided` has qid, question, final, strategy, degraded, reasons, coverage, and where known in_domain, top_score, used_model and tokens; hits without a model's answer are shown with their text, cut to `most` characters."""
    has = lambda c, kind: F.col(c) if c in decided.columns else F.lit(None).cast(kind)
    named = lambda c, missing: F.coalesce(F.col(c), F.lit(missing))
    W = R.REPORT
    say = lambda key, **parts: F.concat(*[F.lit(p) if i % 2 == 0 else parts[p] for i, p in enumerate(W[key])])
    source = say("hit", rank=F.col("rank").cast("string"), score=F.format_string("%.4f", F.col("score").cast("double")), name=named("standard_name", "?"), standard=named("standard", "?"), number=named("article_no", "?"), status=named("status", ""))
    passage = F.concat(F.lit("\n      "), F.substring(strip(named("text", "")), 1, most))
    per = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", source.alias("line"), passage.alias("passage")))).alias("_sources"))
    rows = decided.join(per, "qid", "left")
    used = F.coalesce(has("used_model", "boolean"), F.lit(False))
    lines = F.transform("_sources", lambda x: F.when(used, x["line"]).otherwise(F.concat(x["line"], x["passage"])))
    none = F.lit(None).cast("string")
    reasons = F.nullif(F.array_join("reasons", R.JOINED), F.lit(""))
    verdict = F.when(F.col("degraded"), say("degraded", strategy=F.col("strategy"), reasons=F.coalesce(reasons, F.lit(R.SEE_ABOVE)))).when(F.col("strategy") == "keep", say("kept", coverage=F.col("coverage").cast("string")))
    domain = F.when(has("in_domain", "boolean").isNotNull(), say("domain", inside=F.when(has("in_domain", "boolean"), R.DOMAIN[0]).otherwise(R.DOMAIN[1]), top=F.coalesce(has("top_score", "double").cast("string"), F.lit("?"))))
    rule, line = F.lit("=" * 66), F.lit("-" * 66)
    found = F.when(F.col("_sources").isNotNull(), F.concat(F.array(F.lit(""), line, F.lit(R.SOURCES_HEAD)), lines)).otherwise(F.array(F.lit(""), F.lit(R.NO_SOURCES)))
    tokens = F.when(has("tokens", "long").isNotNull(), F.array(F.lit(""), say("tokens", tokens=has("tokens", "long").cast("string")))).otherwise(F.array(none))
    whole = F.concat(F.array(rule, say("question", question=named("question", "")), rule, say("answer", answer=named("final", "")), F.lit(""), line, verdict, domain), found, tokens)
    return rows.select("qid", *also, F.array_join(F.filter(whole, lambda x: x.isNotNull()), "\n").alias("text"))
