"""Mixing sources to target weights by hierarchical budgeting.

Nodes of the tree (domain, language, source) share their parent's token budget by weight, but none gets more than its
documents give in `epochs` passes. What a node cannot take goes to its siblings by their weights; only what all of them
cannot take was never given to their parent, since a parent's own limit is the sum of its children's. With children sorted
by limit / weight, those at their limit come first, so one window over the siblings fills them exactly, in whole tokens.

A leaf's budget is drawn from seeded epochs: each epoch puts its documents in the order of a seeded hash, and the selection
is the longest prefix of whole documents within the budget. Positions come from sums over ranges of the hash; only the
range in which a leaf's prefix ends is ordered row by row, so no leaf is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, small, stage

#: Documents in one range of a leaf's hashes, about.
RANGE_DOCS = 4096
_BIG = "decimal(38,0)"


def _fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """`nodes` (parent, name, cap, weight, given: the parent's budget) with each node's `budget`."""
    whole = Window.partitionBy(*parent)
    order = whole.orderBy((F.col("cap").cast("double") / F.col("weight")), "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = nodes.withColumn("below", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(_BIG)).withColumn("weights", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    full = F.col("cap").cast(_BIG) * F.col("weights") <= (F.col("given") - F.col("below")) * F.col("weight")
    ranked = ranked.withColumn("full", full)
    # Full nodes are a prefix of the order; the others share what is left.
    left = F.greatest(F.lit(0), F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)))
    ranked = ranked.withColumn("left", left.cast(_BIG)).withColumn("sharing", F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole))
    share = F.expr(f"cast((left * weight) div sharing as {_BIG})")
    ranked = ranked.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(share).cast(_BIG))
    # Tokens lost in rounding go one by one to the first nodes of the order with room.
    spare = F.col("left") - F.coalesce(F.sum(F.when(~F.col("full"), F.col("budget"))).over(whole), F.lit(0))
    turn = F.sum(F.when(~F.col("full") & (F.col("budget") < F.col("cap")), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumn("spare", spare).withColumn("turn", turn)
    extra = F.when(~F.col("full") & (F.col("budget") < F.col("cap")) & (F.col("turn") <= F.col("spare")), 1).otherwise(0)
    return ranked.withColumn("budget", (F.col("budget") + extra).cast("long")).select(*[c for c in nodes.columns if c != "given"], "budget")


def budgets(leaves: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, int]], total: Column | int) -> DataFrame:
    """`leaves` (the levels, cap) with their budget. `weights[level][name]` are whole numbers above 0; names not listed weigh 1."""
    now = leaves.select(*levels, "cap")
    for depth, level in enumerate(levels):
        parent, own = levels[:depth], levels[: depth + 1]
        nodes = leaves.groupBy(*own).agg(F.sum("cap").cast("long").alias("cap"))
        named = weights.get(level, {})
        weight = F.lit(1)
        if named:
            table = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
            weight = F.coalesce(F.try_element_at(table, F.col(level)), F.lit(1))
        nodes = nodes.withColumn("name", F.col(level)).withColumn("weight", weight.cast("long"))
        above = [f"_p{i}" for i in range(depth)]
        if depth == 0:
            nodes = nodes.withColumn("given", F.lit(total).cast(_BIG)).withColumn("_root", F.lit(0))
            filled = _fill(nodes, ["_root"]).drop("_root")
        else:
            up = filled_above.select(*[F.col(c).alias(p) for c, p in zip(parent, above, strict=True)], F.col("budget").cast(_BIG).alias("given"))
            joined = nodes.join(up, [F.col(c) == F.col(p) for c, p in zip(parent, above, strict=True)]).drop(*above)
            filled = _fill(joined, parent)
        filled_above = filled.select(*own, "budget")
    return now.join(filled_above, levels)


def _key(seed: int, epoch: Column, id_col: str) -> Column:
    text = F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mixture(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], share: float = 1.0, epochs: int = 2, seed: int = 17, tokens: Column | None = None, id_col: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """A row for each row of `docs`: doc_id, the levels, n_tokens, budget (of its leaf), copies (how often it is selected, 0 to `epochs`).

    `levels` gives the tree from its top, as columns of `docs`; a null name counts as ''. The total budget is the whole part
    of `share` times all tokens. `tokens` counts those of a row (words of `text` by default). Null ids have one place in the order,
    that of an empty id; rows that tie in it follow by their tokens. Rows without tokens are selected with the prefix that
    reaches them. An empty table gives no row. Of other columns, those in `carry` come along (and settle what still ties), the rest take no part.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    names = list(levels)
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()), (word_count(F.col("text")) if tokens is None else tokens).cast("long").alias("n_tokens"), *carry)
    rows = stage(counted, f"{folder}/counted")
    leaves = stage(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), f"{folder}/leaves")
    total = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * share)
    given = budgets(leaves.select(*names, (F.col("tokens") * epochs).alias("cap")), names, weights, total).drop("cap")
    plan = leaves.join(given, names).select(
        *names, "budget", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).alias("whole"), F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("rest"), F.greatest(F.lit(1), F.expr(f"docs div {RANGE_DOCS}")).alias("ranges")
    )
    plan = small(stage(plan, f"{folder}/plan"))
    placed = rows.join(plan, names).withColumn("key", _key(seed, F.col("whole"), "doc_id"))
    placed = placed.withColumn("range", F.expr("cast(key / 1152921504606846976D * ranges as long)"))
    sums = placed.groupBy(*names, "range").agg(F.sum("n_tokens").alias("in_range"), F.first("rest").alias("rest"))
    upto = F.sum("in_range").over(Window.partitionBy(*names).orderBy("range"))
    # Ranges follow each other: all before the first that passes the budget are selected whole, and that one row by row.
    cut = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("rest")).groupBy(*names).agg(F.min_by(F.struct("range", (F.col("upto") - F.col("in_range")).alias("before")), "range").alias("cut"))
    cut = small(stage(cut.select(*names, F.col("cut.range").alias("cut"), F.col("cut.before").alias("before")), f"{folder}/cut"))
    at = placed.join(cut, names, "left")
    inside = at.filter("range = cut").withColumn("end", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*names).orderBy("key", "doc_id", "n_tokens", *carry).rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.withColumn("more", (F.col("end") <= F.col("rest")) & (F.col("rest") > 0))
    others = at.filter("cut is null or range <> cut").withColumn("more", F.coalesce(F.col("range") < F.col("cut"), F.lit(False)) & (F.col("rest") > 0))
    columns = ["doc_id", *names, "n_tokens", "budget", (F.col("whole") + F.col("more").cast("int")).cast("long").alias("copies"), *carry]
    return inside.select(*columns).unionByName(others.select(*columns))
