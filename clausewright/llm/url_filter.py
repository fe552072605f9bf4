"""URL filter: fixed host-and-path rules first, then association rules over URL tokens that FP-growth mines from labelled URLs."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, small, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATTERN = r"^.*?://([^/?#]*)([^?#]*)"
_LABEL = "label"  # no token of a url, as those have a colon
#: Tokens of a url up to which FP-growth mines; it would make 2**n combinations of n.
LONGEST = 20


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for a null url or one without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)" + _PATTERN, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)" + _PATTERN, 2), F.lit(""))


def rule_for(rules: list[Rule], host_col: Column, path_col: Column) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null where none does. Among equally long ones the first by name."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host_col == r.host) | F.endswith(host_col, F.lit("." + r.host))) & F.startswith(path_col, F.lit(r.path))
        best = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
    return best


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a url: `h:` the labels of its host and `p:` the words of its path and query, in lower case, without pure numbers; `n:` that it has a number."""
    words = lambda text, mark: F.transform(F.filter(F.split(text, r"[^\p{L}\p{N}-]+"), lambda w: (w != "") & ~w.rlike(r"^\p{N}+$")), lambda w: F.concat(F.lit(mark), w))
    rest = F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)", 1), F.lit("")))
    number = F.when(rest.rlike(r"\p{N}"), F.array(F.lit("n:"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words(host(url), "h:"), words(rest, "p:"), number))


def mine_rules(labelled: DataFrame, verdict: str = "block", support: float = 0.002, confidence: float = 0.9, url_col: str = "url", label_col: str = "label", parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Combinations of url tokens that imply `verdict`: (antecedent (array, sorted), confidence, support, first) and (token, same).

    All labelled rows count; those without a url or label take no part, and without rows there are no rules. A rule of which a
    part already is a rule is pruned, as it matches nothing more. So tokens that are rules by themselves, and those too rare
    under `verdict` for any rule, are settled by counts. FP-growth mines the combinations of the others, in which tokens that
    occur in the very same urls stand as one, `same`, the least of them: what holds for one holds for all. `first` is the rarest
    token of a rule, by which it is listed. Where a url has more than LONGEST such tokens, the same rules are grown level by
    level instead, which ends at each rule (see _grown()).
    """
    folder = scratch(labelled.sparkSession)
    rows = labelled.filter(F.col(url_col).isNotNull() & F.col(label_col).isNotNull())
    hit = (F.col(label_col).cast("string") == verdict).cast("long")
    # Equal baskets once, with how often they come and how often under the verdict.
    baskets = stage(rows.select(F.sort_array(url_tokens(F.col(url_col))).alias("tokens"), hit.alias("hit")).groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits")), f"{folder}/baskets")
    total = baskets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1, math.ceil(support * total))
    urls = (F.sum(F.xxhash64("tokens").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("tokens", F.lit(1))))
    stats = baskets.select("tokens", "n", "hits", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.concat_ws(":", *(x.cast("string") for x in urls)).alias("urls"))
    stats = stage(stats.filter(F.col("hits") >= least).withColumn("alone", F.col("hits") / F.col("n") >= confidence), f"{folder}/tokens")
    alone = stats.filter("alone").select(F.array("token").alias("antecedent"), (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / F.lit(max(1, total))).alias("support"), F.col("token").alias("first"))
    same = stats.filter("not alone").groupBy("urls").agg(F.min("token").alias("same"), F.first("n").alias("n"))
    same = stage(stats.filter("not alone").select("token", "urls").join(same, "urls").select("token", "same", "n"), f"{folder}/same")
    few = small(same.filter("token = same").select("token"))
    items = baskets.select("tokens", "n", "hits", F.explode("tokens").alias("token")).join(few, "token").groupBy("tokens", "n", "hits").agg(F.collect_list("token").alias("items"))
    items = stage(items.filter(F.size("items") > 1), f"{folder}/items")
    given, longest = items.agg(F.sum("n"), F.max(F.size("items"))).first()
    if not given:
        return alone, same.select("token", "same")
    if longest > LONGEST:
        return alone.unionByName(_grown(items, small(same.filter("token = same").select("token", "n")), least, confidence, total, folder)), same.select("token", "same")
    mark = F.when(F.col("at") <= F.col("hits"), F.array_append("items", F.lit(_LABEL))).otherwise(F.col("items"))
    single = items.withColumn("at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(mark.alias("items"))
    grower = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / given, minConfidence=confidence, **({"numPartitions": parts} if parts else {}))
    mined = grower.fit(single).associationRules.filter(F.array_contains("consequent", _LABEL))
    mined = stage(mined.select(F.sort_array("antecedent").alias("antecedent"), "confidence", (F.col("support") * given / total).alias("support")), f"{folder}/mined")
    names = small(same.filter("token = same").select("token", "n"))
    listed = mined.select("antecedent", F.explode("antecedent").alias("token")).join(names, "token").groupBy("antecedent").agg(F.min_by("token", F.struct("n", "token")).alias("first"))
    rules = stage(mined.join(listed, "antecedent"), f"{folder}/rules")
    special = rules.select("antecedent", F.explode("antecedent").alias("first"))
    general = rules.select("first", F.col("antecedent").alias("part"))
    wider = special.join(general, "first").filter((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0))
    rules = rules.join(wider.select("antecedent").distinct(), "antecedent", "left_anti")
    return alone.unionByName(rules.select(*alone.columns)), same.select("token", "same")


def _grown(items: DataFrame, names: DataFrame, least: int, confidence: float, total: int, folder: str) -> DataFrame:
    """The rules of mine_rules() on baskets `items` (items, n, hits) of any length: antecedents grow a token at a time.

    Only sets with `least` hits can be part of a rule, and nothing that holds a rule is needed: a level is joined from sets of
    the level below that are neither too rare nor rules, and so are all their parts. Each set is counted in the baskets that
    hold its rarest token. Levels end where no set is left; there are as many sets as have `least` hits and no rule inside.
    """
    baskets = items.select(F.sort_array("items").alias("items"), "n", "hits")
    pair = F.flatten(F.transform("items", lambda x: F.transform(F.filter("items", lambda y: y > x), lambda y: F.array(x, y))))
    wider = baskets.filter("hits > 0").select("hits", F.explode(pair).alias("a")).groupBy("a").agg(F.sum("hits").alias("h")).filter(F.col("h") >= least).select("a")
    found, size = None, 2
    while True:
        first = wider.select("a", F.explode("a").alias("token")).join(names, "token").groupBy("a").agg(F.min_by("token", F.struct("n", "token")).alias("first"))
        met = baskets.select("items", "n", "hits", F.explode("items").alias("first")).join(first, "first").filter(F.size(F.array_except("a", "items")) == 0)
        counted = stage(met.groupBy("a", "first").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).filter(F.col("hits") >= least), f"{folder}/level{size}")
        rules = counted.filter(F.col("hits") / F.col("n") >= confidence)
        rules = rules.select(F.col("a").alias("antecedent"), (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / F.lit(max(1, total))).alias("support"), "first")
        found = rules if found is None else found.unionByName(rules)
        level = counted.filter(F.col("hits") / F.col("n") < confidence).select("a")
        if level.limit(2).count() < 2:
            return found
        one, two = (level.select(F.slice("a", 1, size - 1).alias("head"), F.element_at("a", -1).alias(c)) for c in ("x", "y"))
        joined = one.join(two, "head").filter("x < y").select(F.concat("head", F.array("x", "y")).alias("a"))
        size += 1
        parts = joined.select("a", F.explode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.filter("a", lambda x, j: j != i))).alias("part"))
        whole = parts.join(level.withColumnRenamed("a", "part"), "part").groupBy("a").count()
        wider = whole.filter(F.col("count") == size).select("a")  # all parts are open sets too


def _matches(rows: DataFrame, rules: DataFrame, same: DataFrame) -> DataFrame:
    """Ids (`_row`) of the rows whose `tokens` hold all of some rule's. The index lists each rule under its rarest token."""
    single = small(rules.filter(F.size("antecedent") == 1).select(F.col("first").alias("token")).distinct())
    index = small(rules.filter(F.size("antecedent") > 1).select("first", "antecedent").distinct())
    tokens = rows.select("_row", F.explode("tokens").alias("token"))
    held = tokens.join(small(same), "token").groupBy("_row").agg(F.collect_set("same").alias("held"))
    posted = held.select("_row", "held", F.explode("held").alias("first")).join(index, "first").filter(F.size(F.array_except("antecedent", "held")) == 0)
    return tokens.join(single, "token", "left_semi").select("_row").unionByName(posted.select("_row")).distinct()


def judge_urls(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", **how) -> DataFrame:
    """A row for each row of `pages`: page_id, host, path, rule (null where none fits), verdict (allow or block).

    `labelled` has urls and labels (allow or block) to mine from; where not given, the urls that a fixed rule fits, labelled
    by its verdict. A url that no fixed rule fits is blocked where a mined rule matches it, else allowed; so is a null url,
    which has no tokens. Null and repeated ids stay as they are; other columns take no part.
    """
    url = F.col("_url")
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("_url"))
    judged = source.select("page_id", "_url", host(url).alias("host"), path(url).alias("path"))
    judged = judged.withColumn("_fixed", rule_for(rules, F.col("host"), F.col("path")))
    if labelled is None:
        labelled = judged.filter("_fixed is not null").select(F.col("_url").alias("url"), F.col("_fixed.verdict").alias("label"))
    mined, same = mine_rules(labelled, **how)
    mined = stage(mined, f"{scratch(pages.sparkSession)}/mined")
    # Equal urls are matched once.
    open_urls = judged.filter("_fixed is null and _url is not null").select(F.col("_url").alias("_row")).distinct().withColumn("tokens", url_tokens(F.col("_row")))
    blocked = stage(_matches(open_urls, mined, same), f"{scratch(pages.sparkSession)}/blocked")
    hit = small(blocked.select(F.col("_row").alias("_url"), F.lit("block").alias("_mined")))
    return judged.join(hit, "_url", "left").select("page_id", "host", "path", F.col("_fixed.rule").alias("rule"), F.coalesce("_fixed.verdict", "_mined", F.lit("allow")).alias("verdict"))
