"""One query per operator, over its whole table, and the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import bpe_decode, bpe_encode
from .common import table
from .decontaminate import contaminated
from .dual_tree import dual_tree_clusters
from .mixture import mixture
from .near_dedup import near_duplicates
from .pivot_search import pivot_top_k
from .quality import quality
from .secret_scan import RandomStrings, find_secrets, ordinary_words, random_strings
from .token_counts import token_counts
from .token_output import token_output
from .url_filter import Rule, judge_urls
from .warc import derivatives, responses_of_pages
from .whitening import whiten


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return pivot_top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), tokenizer_path(), words=400_000, text_bytes=4 << 20)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))



def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))



def op9_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))



def op10_markov_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_secrets(docs, RandomStrings(random_strings(), ordinary_words(docs)))



#: Fixed rules of op8.
URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def op8_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)



#: The tree and the weights of op7: source src0 is the crawl, all others are curated.
MIX_WEIGHTS = {"domain": {"crawl": 2, "curated": 3}, "lang": {"en": 5, "de": 2, "fr": 2}, "source": {"src1": 3, "src2": 2}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.75, 2, 17


def mix(docs: DataFrame, **how) -> DataFrame:
    domain = F.when(F.col("source") == "src0", "crawl").otherwise("curated")
    levels = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    return mixture(docs, levels, MIX_WEIGHTS, **({"share": MIX_SHARE, "epochs": MIX_EPOCHS, "seed": MIX_SEED} | how))


def op7_hierarchical_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _mixture_sql(levels: tuple[str, ...] = ("domain", "lang", "source")) -> str:
    steps = []
    for depth, level in enumerate(levels):
        own, parent = ", ".join(levels[: depth + 1]), ", ".join(levels[:depth])
        by = f"PARTITION BY {parent}" if parent else ""
        whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS[level].items())
        given = f"JOIN b{depth - 1} USING ({parent})" if parent else f"CROSS JOIN (SELECT CAST(floor(sum(cap) // {MIX_EPOCHS} * {MIX_SHARE}) AS BIGINT) AS budget FROM leaf)"
        steps.append(f"""
        n{depth} AS (SELECT {own}, cap, w, CAST(budget AS HUGEINT) AS given FROM (
            SELECT {own}, sum(cap) AS cap, CASE {level} {whens} ELSE 1 END AS w FROM leaf GROUP BY {own}) {given}),
        f{depth} AS (SELECT *, cap * sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            <= (given - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS is_full
            FROM n{depth} WINDOW o AS ({by} ORDER BY CAST(cap AS DOUBLE) / w, {level})),
        s{depth} AS (SELECT *, CASE WHEN is_full THEN cap ELSE (given - coalesce(sum(cap) FILTER (is_full) OVER p, 0)) * w // sum(w) FILTER (NOT is_full) OVER p END AS part
            FROM f{depth} WINDOW p AS ({by})),
        t{depth} AS (SELECT *, least(given, sum(cap) OVER p) - sum(part) OVER p AS spare,
            sum(CASE WHEN NOT is_full AND part < cap THEN 1 ELSE 0 END) OVER ({by} ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS UNBOUNDED PRECEDING) AS turn
            FROM s{depth} WINDOW p AS ({by})),
        b{depth} AS (SELECT {own}, CAST(part + CASE WHEN NOT is_full AND part < cap AND turn <= spare THEN 1 ELSE 0 END AS BIGINT) AS budget FROM t{depth})""")
    keys = ", ".join(levels)
    return rf"""
        WITH d AS (SELECT doc_id, CASE WHEN source = 'src0' THEN 'crawl' ELSE 'curated' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
        leaf AS (SELECT {keys}, sum(n_tokens) * {MIX_EPOCHS} AS cap FROM d GROUP BY {keys}),{",".join(steps)},
        p AS (SELECT d.*, budget, CAST(CASE WHEN cap > 0 THEN budget // (cap // {MIX_EPOCHS}) ELSE 0 END AS BIGINT) AS whole, CASE WHEN cap > 0 THEN budget % (cap // {MIX_EPOCHS}) ELSE 0 END AS rest
            FROM d JOIN leaf USING ({keys}) JOIN b{len(levels) - 1} USING ({keys})),
        e AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {keys} ORDER BY substr(md5('{MIX_SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM p)
        SELECT doc_id, {keys}, n_tokens, budget, CAST(whole + CASE WHEN upto <= rest AND rest > 0 THEN 1 ELSE 0 END AS BIGINT) AS copies FROM e
    """



def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses_of_pages(table(spark, sf_dir, "pages")))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    plain = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(plain, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: The centroids, rounds, components and scale of op12.
CLUSTERS, CLUSTER_ROUNDS, CLUSTER_DIM, CLUSTER_SCALE = 16, 3, 64, 64


def op12_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree_clusters(table(spark, sf_dir, "embeddings"), CLUSTERS, CLUSTER_ROUNDS, CLUSTER_DIM, CLUSTER_SCALE)


def _clusters_sql() -> str:
    """Every vector against every centroid, round by round; a quotient that is rounded down also where the sum is negative."""
    rounds = []
    for i in range(CLUSTER_ROUNDS + 1):
        rounds.append(f"""a{i} AS (SELECT row, cluster, d FROM (SELECT v.row, c.cluster, d, row_number() OVER (PARTITION BY v.row ORDER BY d, c.cluster) AS turn FROM v, c{i} c,
            LATERAL (SELECT CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d)) WHERE turn = 1)""")
        rounds.append(f"""m{i + 1} AS (SELECT cluster, list((s - (s % n + n) % n) // n ORDER BY i) AS x FROM (
            SELECT cluster, i, sum(e) AS s, count(*) AS n FROM (SELECT cluster, generate_subscripts(x, 1) AS i, unnest(x) AS e FROM a{i} JOIN v USING (row)) GROUP BY cluster, i) GROUP BY cluster),
        c{i + 1} AS (SELECT cluster, CAST(coalesce(m.x, c.x) AS BIGINT[]) AS x FROM c{i} c LEFT JOIN m{i + 1} m USING (cluster))""")
    last = CLUSTER_ROUNDS
    return f"""
        WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor({CLUSTER_SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = {CLUSTER_DIM} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS INTEGER) AS cluster, x FROM v QUALIFY cluster < {CLUSTERS}),
        {", ".join(rounds[:-1])}
        SELECT vec_id, cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{last} JOIN v USING (row) JOIN c{last} c USING (cluster)
    """


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), 16, 64, 1_000_000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_pivot_top_k": op2_pivot_top_k,
    "op3_quality_trees": op3_quality_trees,
    "op4_token_output": op4_token_output,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_hierarchical_mixture": op7_hierarchical_mixture,
    "op8_url_association_rules": op8_url_association_rules,
    "op9_unigram_token_counts": op9_unigram_token_counts,
    "op10_markov_secret_scan": op10_markov_secret_scan,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_dual_tree_lloyd": op12_dual_tree_lloyd,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op2_pivot_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op5_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        sh AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        k AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT u, v FROM k JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * shared >= 85 * (nu.n + nv.n - shared)),
        r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.other),
        c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
    """,
    "op7_hierarchical_mixture": _mixture_sql(),
    "op12_dual_tree_lloyd": _clusters_sql(),
}
