"""Exact top-k by inner product on a pivot-distance index.

With m the largest squared norm, each vector v gets one more component, sqrt(m - |v|**2), and each query a zero: the nearest
vectors are then those of the greatest inner products. Vectors are keyed by (nearest pivot, distance to it) and sorted so
that each block of BLOCK rows of one pivot is an annulus around it. A query whose distance to that pivot is x can score with
a vector of the annulus [near, far] no more than (|q|**2 + m - gap**2) / 2, gap being what x lies outside the annulus.
A first step looks into the annuli around the query's own position, at its nearest pivots, and gives a k-th best score; the
second expands to all annuli whose bound still reaches it. The queries are a stated set: they are broadcast in chunks of about
QUERY_BYTES, and each task keeps the k best of its annuli, so no vector is shipped. Scores are exact integers; only bounds are
floating-point, with slack.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stage

BLOCK, SAMPLE = 1024, 4096
#: Bytes of queries that are broadcast at a time; queries that are scored against a block at a time.
QUERY_BYTES, QUERY_BLOCK = 16 << 20, 256
_INDEX = "pivot int, above double, near double, far double, ids binary, vectors binary"


def whole_components(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component as double. Null vectors, and such as hold a null or non-finite component, go."""
    x = F.col(vector_col)
    valid = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.filter(valid & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of floats; shorter vectors are filled with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == dim * len(size):
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim))
    out[np.arange(dim) < size[:, None]] = flat
    return out


def _lift(m: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([m, np.sqrt(np.maximum(0.0, most - np.einsum("ij,ij->i", m, m)))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)))


def choose_pivots(sample: np.ndarray, pivots: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of a few rounds of k-means on the sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:pivots]]
    for _ in range(rounds):
        near = _distances(sample, centres).argmin(axis=1)
        centres = np.stack([sample[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(len(centres))])
    return centres


def _keyer(centres: np.ndarray, most: float, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_lift(_matrix(batch.column(1), dim), most), centres)
            near = d.argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(d[np.arange(len(near)), near]), batch.column(0), batch.column(1)], ["pivot", "distance", "id", "v"])

    return run


def _blocker(dim: int):
    """Cuts sorted (pivot, distance, id, v) rows into blocks of one pivot each. `above`: the greatest distance before the block, where its task had one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, above = None, (-1, 0.0)

        def out(block: tuple) -> pa.RecordBatch:
            nonlocal above
            pivot, distance, ids, m = block
            before = above[1] if above[0] == pivot[0] else -np.inf
            above = (pivot[0], float(distance[-1]))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in (([int(pivot[0])], pa.int32()), ([before], pa.float64()), ([float(distance[0])], pa.float64()), ([float(distance[-1])], pa.float64()), ([ids.tobytes()], pa.binary()), ([m.tobytes()], pa.binary()))], ["pivot", "above", "near", "far", "ids", "vectors"])

        for batch in batches:
            pivot, distance, ids = (batch.column(i).to_numpy() for i in range(3))
            m = _matrix(batch.column(3), dim)
            for s, e in zip(cuts := [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist()], [*cuts[1:], len(pivot)], strict=True):
                if e > s:
                    more = (pivot[s:e], distance[s:e], ids[s:e], m[s:e])
                    if held and held[0][0] != pivot[s]:
                        yield out(held)
                        held = None
                    held = tuple(np.concatenate(x) for x in zip(held, more, strict=True)) if held else more
                    while held and len(held[0]) >= BLOCK:
                        yield out(tuple(x[:BLOCK] for x in held))
                        held = tuple(x[BLOCK:] for x in held) if len(held[0]) > BLOCK else None
        if held:
            yield out(held)

    return run


def _bounds(q: np.ndarray, centre: np.ndarray, near: float, far: float, most: float) -> np.ndarray:
    """The greatest score that each query could have with a vector of the annulus."""
    x = np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", q, q) + centre @ centre - 2 * (q @ centre[:-1])))
    gap = np.maximum(0.0, np.maximum(near - x, x - far) - 1e-6 * (1 + x + far))
    return (np.einsum("ij,ij->i", q, q) + most - gap * gap) / 2 + 1e-6 * (1 + most)


def _exact(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond what doubles hold exactly by Python's integers, and held within a long."""
    top = (np.abs(q).max(initial=0.0)) * (np.abs(m).max(initial=0.0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q @ m.T).astype(np.int64)
    whole = lambda x: np.array([[int(e) for e in row] for row in x], object).reshape(x.shape)
    return np.clip(whole(q) @ whole(m).T, -(2**63), 2**63 - 1).astype(np.int64)


def _scorer(centres: np.ndarray, most: float, dim: int, k: int, shared, probe: bool):
    """The k best of the task's annuli for each query: `probe` looks into those where the queries themselves lie, else into all that could reach a query's k-th score so far, which rises on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, qids, queries, floors, places, depths = shared.value
        floor = floors.copy()
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                ids, m = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"]).reshape(-1, dim)
                if probe:
                    able = ((places == row["pivot"]) & (depths > row["above"]) & (depths <= row["far"])).any(axis=1)
                else:
                    able = _bounds(queries, centres[row["pivot"]], row["near"], row["far"], most) >= floor
                able = np.flatnonzero(able)
                for part in (able[i : i + QUERY_BLOCK] for i in range(0, len(able), QUERY_BLOCK)):
                    score = _exact(queries[part], m)
                    for i, own in zip(part.tolist(), score, strict=True):
                        fits = np.flatnonzero((own >= floor[i]) & (ids != qids[i]))
                        if len(fits):
                            s, d = own[fits], ids[fits]
                            if i in best:
                                s, d = np.concatenate([best[i][0], s]), np.concatenate([best[i][1], d])
                            order = np.lexsort((d, -s))[:k]
                            best[i] = s[order], d[order]
                            if len(order) == k:
                                floor[i] = max(floor[i], float(s[order[-1]]))
        for i in range(0, len(found := sorted(best)), 1000):
            part = found[i : i + 1000]
            size = [len(best[j][0]) for j in part]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(number[part], size)), pa.array(np.repeat(qids[part], size)), pa.array(np.concatenate([best[j][1] for j in part])), pa.array(np.concatenate([best[j][0] for j in part]))], ["q", "query_id", "vec_id", "score"])

    return run


def pivot_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k greatest integer inner products: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    Components are floor(scale * x). Rows of either side whose id is null or whose vector is null, empty or holds a null or
    non-finite component take no part. A vector is no candidate of the query of the same id. Vectors of unequal length meet
    in their common components. Rows that repeat an id are candidates of their own, and queries of their own, each with its
    own ranks. Scores beyond a long are held at its ends. Fewer than k candidates give fewer rows; empty tables give none.
    Other columns take no part. Pivots are fitted on at most SAMPLE vectors, those of the smallest hashes of the id; every
    vector is indexed. A chunk of queries makes two passes over the index.
    """
    spark = vectors.sparkSession
    folder = scratch(spark)
    schema = "q long, query_id long, vec_id long, score long"
    valid = stage(whole_components(vectors, id_col, vector_col, scale), f"{folder}/vectors")
    asked = stage(whole_components(queries, id_col, vector_col, scale).withColumn("q", F.monotonically_increasing_id()), f"{folder}/queries")
    dim, most = valid.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))).first()
    width, total = asked.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    if dim is None or width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(dim, width)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = np.array([list(r.v) + [0.0] * (dim - len(r.v)) for r in valid.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
    centres = choose_pivots(_lift(sample, most), min(pivots, len(sample)))
    keyed = stage(valid.mapInArrow(_keyer(centres, most, dim), "pivot int, distance double, id long, v array<double>"), f"{folder}/keyed")
    order = ("pivot", "distance", "id", "row")  # the last parts rows that repeat
    index = keyed.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    index = stage(index.select("pivot", "distance", "id", "v").mapInArrow(_blocker(dim), _INDEX), f"{folder}/index")
    ends = {r.pivot: r.far for r in index.groupBy("pivot").agg(F.max("far").alias("far")).collect()}  # a row for each pivot
    used = np.array(sorted(ends))

    found, by_query = None, Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    chunks = max(1, math.ceil(total * dim * 8 / QUERY_BYTES))
    for chunk in range(chunks):
        own = asked.filter(F.pmod(F.xxhash64("q"), F.lit(chunks)) == chunk).collect()
        if not own:
            continue
        m = np.zeros((len(own), dim))
        for i, r in enumerate(own):
            m[i, : len(r.v)] = r.v
        number, qids = np.array([r.q for r in own]), np.array([r.id for r in own])
        x = _distances(np.column_stack([m, np.zeros(len(m))]), centres[used])
        near = np.argsort(x, axis=1, kind="stable")[:, :2]
        places, depths = used[near], np.minimum(np.take_along_axis(x, near, axis=1), np.array([ends[p] for p in used])[near])
        first = spark.sparkContext.broadcast((number, qids, m, np.full(len(own), -np.inf), places, depths))
        probed = index.mapInArrow(_scorer(centres, most, dim, k, first, True), schema)
        kth = {r.q: float(r.score) for r in probed.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") == k).select("q", "score").collect()}
        first.destroy()
        floors = np.array([kth.get(q, -np.inf) for q in number.tolist()])
        second = spark.sparkContext.broadcast((number, qids, m, floors, places, depths))
        best = index.mapInArrow(_scorer(centres, most, dim, k, second, False), schema).withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
        if chunks > 1:  # a chunk is done, and its broadcast gone, before the next begins
            best = stage(best, f"{folder}/found{chunk}")
            second.destroy()
        found = best if found is None else found.unionByName(best)
    return found.select("query_id", "rank", "vec_id", "score")
