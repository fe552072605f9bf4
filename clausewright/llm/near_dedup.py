"""MinHash near-duplicates with tensored banding.

Two collections A and B of `tables` two-minhash groups each are computed per document. Every pair (A_i, B_j) is the key of
one of `tables`**2 hash tables, so 4 * `tables` minhashes do the work of 4 * `tables`**2. A pair of documents is a candidate
where one A_i and one B_j agree; all candidates that are not already connected are verified on their full shingle sets.

Size of the work: documents of one and the same shingle set are one node from the start. Only nodes of which some A_i and
some B_j also occur in another node are given keys (16 rows a node tell that, where all keys would be 64), and of those only
keys of agreeing groups. A node carries its keys as one array, so joins by id have one row a node. In each bucket, all are first verified against its smallest id; what stays unconnected within a
bucket is then verified pair by pair across components, so a bucket of n near copies costs about n pairs, and no link is lost.
Near copies share keys and shingles, so tables of them are small as files and large as rows: such sides of joins are marked to
be shuffled, and what the driver broadcasts has been counted before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, mix64, scratch, shuffled, small, stage, text_slices
from .components import components
from .shingles import shingle_sets

TABLES = 8
#: A bucket of more documents than this is not paired directly; a shingle in at most so many of its documents is rare.
LARGE, RARE = 32, 8
#: A set of shingles with more keys than this meets a document once for each key that they share, and the pair is made unique behind that.
SET_KEYS = 256
#: Shingles of large buckets that a task counts, about.
COUNTED = 1 << 18


def _signer(words: int, tables: int):
    seeds = mix64(np.arange(1, 8 * tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    mult, add = seeds[: 4 * tables] | np.uint64(1), seeds[4 * tables :]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, data, at in text_slices(batch.column(1)):
                sets, start = shingle_sets(data, at, words)
                n = len(at) - 1
                size = np.diff(start)
                full = np.flatnonzero(size)
                groups = np.zeros((n, 2 * tables), np.uint64)
                cls = np.zeros((n, 2), np.uint64)
                if len(full):
                    cut = start[full]
                    cls[full, 0] = np.add.reduceat(mix64(sets + np.uint64(11)), cut)
                    cls[full, 1] = np.add.reduceat(mix64(sets * mult[0] + add[1]), cut) + size[full].astype(np.uint64)
                    for g in range(2 * tables):
                        low, high = (np.minimum.reduceat((sets * mult[h] + add[h]) >> np.uint64(32), cut) for h in (2 * g, 2 * g + 1))
                        groups[full, g] = low << np.uint64(32) | high
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(cls.tobytes())]).cast(pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 2 * tables), pa.array(groups.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(row, n), pa.array(size), fixed, lists], ["id", "n_shingles", "cls", "groups"])
        give_back()

    return sign


def _setter(words: int):
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in text_slices(batch.column(1)):
                sets, start = shingle_sets(data, at, words)
                lists = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(at) - 1), lists], ["id", "shingles"])
        give_back()

    return sets_of


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, shingles) rows, a row for each shingle of a batch: s, how many of its rows have it, and their ids, if RARE at most."""
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        ids = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=flat[order][:1] - 1)) if len(flat) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(flat)))
        told = np.where(n <= RARE, n, 0)
        held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(told)]).astype(np.int32)), pa.array(ids[order][np.repeat(n <= RARE, n)]))
        yield pa.RecordBatch.from_arrays([pa.array(flat[order][first]), pa.array(n.astype(np.int32)), held], ["s", "n", "ids"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (u, v), those with 100 * |intersection| >= percent * |union|, on full sets."""
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("s"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    return pairs.join(shuffled(left), "u").join(shuffled(right), "v").filter(100 * both >= percent * (F.size("s") + F.size("t") - both)).select("u", "v")


def _large_bucket_pairs(nodes: DataFrame, sets: DataFrame, percent: int, folder: str) -> DataFrame:
    """The pairs (u, v) across components of `nodes` (id, n, component, keys: its large buckets, all1 and all2: a digest of its shingles) that connect all that could be linked, without forming all pairs.

    A shingle is rare if at most RARE of these documents have it. Pairs that share a rare one are found by it, whose lists are
    short. A pair that shares none has in common what their sets of other shingles have in common, whatever else they hold: so
    of all documents of one such set the shortest, its head, is linked with every document that one of them is linked with.
    Hence each document meets the heads of the sets in its buckets, if the sizes allow a link. A null n (an id that repeats with
    other texts) is a set of its own and excludes nothing.
    """
    own = sets.join(small(nodes.select("id")), "id", "left_semi").select("id", "shingles")
    # Each task makes a row of a common shingle, so tasks are as many as the shingles ask for and not as the tables were dealt.
    tasks = math.ceil((nodes.agg(F.sum("n")).first()[0] or 0) / COUNTED)
    own = stage(own.repartition(max(1, tasks)).mapInArrow(_counted, "s long, n int, ids array<long>"), f"{folder}/large_shingles")
    per = own.groupBy("s").agg(F.sum("n").alias("docs"), F.min(F.get("ids", F.lit(0))).alias("id")).filter(F.col("docs") <= RARE)
    per = stage(per, f"{folder}/rare")
    listed = stage(own.join(shuffled(per.filter("docs > 1").select("s")), "s").select("s", F.explode("ids").alias("id")), f"{folder}/listed")
    digest = [F.bit_xor(F.xxhash64("s", F.lit(i))).alias(f"rare{i}") for i in (1, 2)]
    rare = per.filter("docs = 1").select("id", "s").unionByName(listed.select("id", "s")).groupBy("id").agg(F.count(F.lit(1)).alias("rare"), *digest)
    others = F.concat_ws(":", *(F.col(f"all{i}").bitwiseXOR(F.coalesce(f"rare{i}", F.lit(0))).cast("string") for i in (1, 2)))  # a digest of the shingles that are not rare
    bounds = nodes.join(shuffled(rare), "id", "left").withColumn("set", F.when(F.col("n").isNull(), F.concat(F.lit("="), F.col("id").cast("string"))).otherwise(others))
    nodes = bounds.withColumn("common", F.col("n") - F.coalesce("rare", F.lit(0))).drop("rare", "rare1", "rare2", "all1", "all2")
    nodes = stage(nodes, f"{folder}/bounds")

    could = lambda shared: F.coalesce((100 + percent) * (F.least("common_u", "common_v") + shared) >= percent * (F.col("n_u") + F.col("n_v")), F.lit(True))
    bounded = F.col("n_u").isNotNull() & F.col("n_v").isNotNull()  # least() passes over a null
    crosses = F.col("component_u") != F.col("component_v")
    side = lambda x, *also: nodes.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "component", "common", *also)))

    wide = nodes.filter(F.coalesce(100 * F.col("common") >= percent * F.col("n"), F.lit(True)))
    heads = wide.groupBy("set").agg(F.min(F.struct("n", "id", "component", "common")).alias("h"))
    heads = stage(heads.select("set", F.col("h.id").alias("v"), F.col("h.n").alias("n_v"), F.col("h.component").alias("component_v"), F.col("h.common").alias("common_v")), f"{folder}/heads")
    listed_heads = stage(wide.select("set", F.explode("keys").alias("key")).distinct(), f"{folder}/set_keys")
    few = listed_heads.groupBy("set").count().filter(F.col("count") <= SET_KEYS).select("set")
    keys = listed_heads.join(shuffled(few), "set").groupBy("set").agg(F.collect_list("key").alias("keys_v"))
    listed_heads = listed_heads.join(shuffled(heads.join(shuffled(keys), "set", "left")), "set").drop("set")
    asking = wide.select(F.explode("keys").alias("key"), F.col("id").alias("u"), *(F.col(c).alias(f"{c}_u") for c in ("n", "component", "common", "keys")))
    once_each = F.coalesce(F.array_min(F.array_intersect("keys_u", "keys_v")) == F.col("key"), F.lit(True))  # they meet in many buckets
    without = asking.join(shuffled(listed_heads), "key").filter(crosses & (~bounded | could(F.lit(0))) & once_each).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = listed.select("s", F.col("id").alias("u")).join(shuffled(listed.select("s", F.col("id").alias("v"))), "s").filter("u > v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("shared"))
    with_rare = met.join(shuffled(side("u")), "u").join(shuffled(side("v")), "v").filter(crosses & (~bounded | could(F.col("shared")))).select("u", "v")
    return without.distinct().unionByName(with_rare).distinct()


def _set_digest(i: int):
    return F.aggregate("shingles", F.lit(0).cast("long"), lambda x, s: x.bitwiseXOR(F.xxhash64(s, F.lit(i))))


def _bit(t, tables: int):
    """The bits of the two groups of key t in a mask of groups."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (t / tables).cast("int")).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (tables + t % tables).cast("int")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, tables: int = TABLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    Words are runs of other than ASCII white space, A-Z lower-cased; a text of fewer than `words` words has its whole sequence
    as its one shingle. Null and empty texts have no shingle and no link: each is its own component. `id_col` is a key; rows
    that repeat one with the same set are one node, with other sets all their links count for that id. Rows without an id link
    nothing and have null component_id and kept = false. Other columns, whatever their names, take no part. Texts are processed whole.
    A link is missed with a probability below 2 * (1 - s**2) ** tables for similarity s: 0.00014 at 0.85 with 8 tables, 0.0006 at 0.8.
    """
    folder = scratch(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = stage(source.mapInArrow(_signer(words, tables), "id long, n_shingles long, cls binary, groups array<bigint>"), f"{folder}/signed")
    classes = stage(signed.filter("n_shingles > 0 and id is not null").groupBy("cls").agg(F.min("id").alias("id"), F.first("groups").alias("groups")), f"{folder}/classes")

    single = classes.select("id", F.posexplode("groups").alias("g", "x")).select("id", "g", F.xxhash64("g", "x").alias("key"))
    shared = single.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key")
    half = (1 << tables) - 1
    agreeing = single.join(shuffled(shared), "key", "left_semi").groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, g)")).alias("mask")).filter(((F.col("mask").bitwiseAND(half)) > 0) & (F.col("mask") > half))
    # A row for each node, with its keys as an array; rows of single keys are made only to meet by key.
    pairs = F.filter(F.sequence(F.lit(0), F.lit(tables * tables - 1)), lambda t: F.col("mask").bitwiseAND(_bit(t, tables)) == _bit(t, tables))
    keys = F.transform(pairs, lambda t: F.xxhash64(t, F.get("groups", (t / tables).cast("int")), F.get("groups", tables + t % tables)))
    nodes = stage(classes.join(shuffled(agreeing), "id").select("id", keys.alias("keys")), f"{folder}/nodes")
    single = nodes.select("id", F.explode("keys").alias("key"))
    heads = single.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key", "lo")
    met = F.collect_set(F.struct("key", "lo")).alias("met")
    buckets = stage(single.join(shuffled(heads), "key").groupBy("id").agg(met), f"{folder}/buckets")

    lows = F.explode(F.array_distinct(F.transform("met", lambda m: m["lo"]))).alias("v")
    linked = stage(buckets.select(F.col("id").alias("u"), lows).filter("u <> v").distinct(), f"{folder}/first_pairs")
    wanted = linked.select(F.col("u").alias("id")).union(linked.select("v")).distinct()
    sets = stage(source.join(small(wanted), "id", "left_semi").mapInArrow(_setter(words), "id long, shingles array<bigint>"), f"{folder}/sets")
    edges = stage(_verified(linked, sets, percent), f"{folder}/edges1")

    # What is still unconnected within a bucket: every pair across components, once.
    named = components(edges, f"{folder}/first")
    member = stage(buckets.join(shuffled(named), "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.transform("met", lambda m: m["key"]).alias("keys")), f"{folder}/member")
    single = member.select("id", "component", F.explode("keys").alias("key"))
    split = single.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), (F.count(F.lit(1)) > LARGE).alias("large")).filter("a < b").select("key", "large")
    member = stage(single.join(shuffled(split), "key"), f"{folder}/open")
    crosses = (F.col("u") > F.col("v")) & (F.col("cu") != F.col("cv"))
    left, right = (member.filter("not large").select("key", F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "uv")
    few = left.join(shuffled(right), "key").filter(crosses).select("u", "v").distinct()
    large = stage(member.filter("large").groupBy("id").agg(F.first("component").alias("component"), F.collect_set("key").alias("keys")), f"{folder}/in_large")
    every = [_set_digest(i).alias(f"all{i}") for i in (1, 2)]
    once = sets.join(small(large.select("id")), "id", "left_semi").select("id", F.size("shingles").alias("n"), *every)
    once = once.groupBy("id").agg(F.when(F.count(F.lit(1)) == 1, F.first("n")).alias("n"), F.first("all1").alias("all1"), F.first("all2").alias("all2"))  # an id that repeats with other texts gets no bound
    large = stage(large.join(shuffled(once), "id"), f"{folder}/large")
    rest = few.unionByName(_large_bucket_pairs(large, sets, percent, folder)).distinct().join(shuffled(linked), ["u", "v"], "left_anti")
    more = stage(_verified(stage(rest, f"{folder}/second_pairs"), sets, percent), f"{folder}/edges2")
    final = components(edges.unionByName(more), f"{folder}/second")

    member = classes.join(shuffled(final), "id", "left").select("cls", F.coalesce("component", "id").alias("component"))
    out = signed.select("id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("cls")).alias("cls")).join(shuffled(member), "cls", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
