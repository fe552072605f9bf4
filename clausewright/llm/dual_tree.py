"""Lloyd's rounds on two cover trees: one over each block of vectors, made once, and one over the centroids, made each round.

A cover tree holds nested nets: the points of level i are more than 2**i apart and within 2**(i + 1) of their parents. It comes
from a farthest-first order of the points, in which the points of insertion radius over 2**i are the net of level i. Equal
vectors are one point with all their ids. Both trees are descended together, level by level: a pair of nodes goes where no
vector below the one can have its nearest centroid below the other, by the distance of their points and their radii. A node
with one candidate left is assigned whole; pairs of leaves are compared exactly, in integers, ties to the smaller number.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stage, whole_matrix, whole_vectors

#: Vectors of one tree at most.
BLOCK = 1024
#: Components beyond this, where squared distances no longer fit a long, are an error.
LARGEST = 1 << 27
_EXACT = 1 << 22  # below it, sums of 64 products are exact as doubles
_NODES = np.dtype([("point", "<i4"), ("radius", "<f8"), ("first", "<i4"), ("last", "<i4"), ("child", "<i4"), ("children", "<i4")])
_TREE = "ids binary, of binary, vectors binary, nodes binary"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances of rows of long integers, exact."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < _EXACT and a.shape[1] <= 64:
        x, y = a.astype(float), b.astype(float)
        return ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct points in which each node's are a range, and the nodes, children side by side, the root first."""
    apart = squared(points, points)
    n = len(points)
    order, near, radius2 = np.zeros(n, np.int64), apart[0].copy(), np.zeros(n, np.int64)
    for j in range(1, n):  # farthest first
        order[j] = far = int(near.argmax())
        radius2[j] = near[far]
        np.minimum(near, apart[far], out=near)
    level = np.full(n, 1 << 20, np.int64)
    level[1:] = np.ceil(np.log2(radius2[1:].astype(float)) / 2).astype(np.int64) - 1  # 2**level < insertion radius
    kids: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for j in range(1, n):
        net = order[: int(np.searchsorted(-level[:j], -level[j], "left"))]  # points of a higher level
        kids[int(net[apart[order[j]][net].argmin()])][int(level[j])].append(int(order[j]))
    # A node is a point and the levels at which it still has children, of which it is one itself at the next of them.
    steps = {p: sorted(by, reverse=True) for p, by in kids.items()}
    nodes, queue, places = [(0, 0)], 0, []
    while queue < len(nodes):
        p, depth = nodes[queue]
        queue += 1
        own = steps.get(p, [])
        below = [(p, depth + 1), *((c, 0) for c in kids[p][own[depth]])] if depth < len(own) else []
        places.append((len(nodes), len(below)))
        nodes += below
    out = np.zeros(len(nodes), _NODES)
    out["child"], out["children"] = np.array(places).T
    span = np.where(out["children"] == 0, 1, 0)
    for i in range(len(nodes) - 1, -1, -1):  # children stand behind their parents
        c, k = places[i]
        if k:
            span[i] = span[c : c + k].sum()
    first = np.zeros(len(nodes), np.int64)
    for i, (c, k) in enumerate(places):
        if k:
            first[c : c + k] = first[i] + np.cumsum(span[c : c + k]) - span[c : c + k]
    points_of = np.array([p for p, _ in nodes])
    leaf = out["children"] == 0
    laid = np.zeros(n, np.int64)
    laid[first[leaf]] = points_of[leaf]
    place = np.empty(n, np.int64)
    place[laid] = np.arange(n)
    out["point"], out["first"], out["last"] = place[points_of], first, first + span
    for i in np.flatnonzero(~leaf):
        out["radius"][i] = np.sqrt(apart[points_of[i]][laid[first[i] : first[i] + span[i]]].max())
    return laid, out


def _children(nodes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes, a leaf being its own, and how many each has."""
    count = np.maximum(nodes["children"][at], 1)
    start = np.where(nodes["children"][at] == 0, at, nodes["child"][at])
    end = np.cumsum(count)
    return np.repeat(start - end + count, count) + np.arange(end[-1] if len(end) else 0), count


def nearest(vectors: np.ndarray, tree: np.ndarray, centroids: np.ndarray, number: np.ndarray, over: np.ndarray) -> np.ndarray:
    """For each vector (in the order of its tree), the number of the nearest centroid; `centroids`, `number` in the order of the tree `over` them."""
    owner = np.full(len(vectors), -1, np.int64)
    bound = np.full(len(tree), np.inf)
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(q):
        gap = vectors[tree["point"][q]] - centroids[over["point"][r]]
        d2 = np.einsum("ij,ij->i", gap, gap)
        d = np.sqrt(d2.astype(float))
        start = np.flatnonzero(np.diff(q, prepend=-1))
        bound[q[start]] = np.minimum(bound[q[start]], np.minimum.reduceat(d, start) + tree["radius"][q[start]])
        keep = d - tree["radius"][q] - over["radius"][r] <= bound[q] * (1 + 1e-9) + 1e-9
        q, r, d2 = q[keep], r[keep], d2[keep]
        start = np.flatnonzero(np.diff(q, prepend=-1))
        many, own = np.diff(np.append(start, len(q))), q[start]
        settled = np.logical_and.reduceat(over["children"][r] == 0, start)  # only single centroids are left
        alone = settled & (many == 1)
        for i in np.flatnonzero(alone):
            owner[tree["first"][own[i]] : tree["last"][own[i]]] = number[over["point"][r[start[i]]]]
        exact = settled & ~alone & (tree["children"][own] == 0)
        pair = np.flatnonzero(np.repeat(exact, many))
        pair = pair[np.lexsort((number[over["point"][r[pair]]], d2[pair], q[pair]))]
        best = pair[np.diff(q[pair], prepend=-1) > 0]
        owner[tree["first"][q[best]]] = number[over["point"][r[best]]]
        going = ~np.repeat(alone | exact, many)
        q, r = q[going], r[going]
        if not len(q):
            break
        down_q, many_q = _children(tree, q)
        r = np.repeat(r, many_q)
        parent = np.repeat(q, many_q)
        bound[down_q] = np.minimum(bound[down_q], bound[parent])
        down_r, many_r = _children(over, r)
        q, r = np.repeat(down_q, many_r), down_r
        order = np.argsort(q, kind="stable")
        q, r = q[order], r[order]
    return owner


def _block(ids: pa.Array, vectors: np.ndarray) -> dict[str, bytes]:
    if len(vectors) and max(-int(vectors.min()), int(vectors.max())) > LARGEST:
        raise ValueError("a component is too large")
    distinct, of = np.unique(vectors, axis=0, return_inverse=True)
    laid, nodes = cover_tree(distinct)
    place = np.empty(len(laid), np.int32)
    place[laid] = np.arange(len(laid), dtype=np.int32)
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([ids], ["id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return {"ids": sink.getvalue().to_pybytes(), "of": place[of.ravel()].tobytes(), "vectors": distinct[laid].astype("<i4").tobytes(), "nodes": nodes.tobytes()}


def _planter(dim: int):
    """Trees over blocks of the (id, v) rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def planted(end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            whole = whole[0] if whole else None
            done = count if end else count - count % BLOCK
            for first in range(0, done, BLOCK):
                part = whole.slice(first, min(BLOCK, done - first))
                made = _block(part.column(0), whole_matrix(part.column(1), dim))
                yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary()) for k, v in made.items()})
            held, count = ([whole.slice(done)] if whole is not None and done < count else []), count - done

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= BLOCK:
                yield from planted(False)
        if count:
            yield from planted(True)

    return run


def _read(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = pa.ipc.open_stream(row["ids"]).read_all().column(0).combine_chunks()
            vectors = np.frombuffer(row["vectors"], "<i4").reshape(-1, dim).astype(np.int64)
            yield ids, np.frombuffer(row["of"], "<i4"), vectors, np.frombuffer(row["nodes"], _NODES)


def _centroid_tree(centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    distinct, first = np.unique(np.array(centroids, np.int64), axis=0, return_index=True)  # of equal ones the smallest number
    laid, nodes = cover_tree(distinct)
    return distinct[laid], first[laid], nodes


def _summer(shared, k: int, dim: int):
    """For each cluster, how many of the task's vectors are nearest to it, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, of, vectors, nodes in _read(batches, dim):
            owner = nearest(vectors, nodes, *shared.value)
            weight = np.bincount(of, minlength=len(vectors))
            np.add.at(count, owner, weight)
            np.add.at(total, owner, vectors * weight[:, None])
        some = np.flatnonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dim), pa.array(total[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), lists], ["cluster", "n", "sums"])

    return run


def _assigner(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, number, _ = shared.value
        place = np.zeros(number.max() + 1, np.int64)
        place[number] = np.arange(len(number))
        for ids, of, vectors, nodes in _read(batches, dim):
            owner = nearest(vectors, nodes, *shared.value)
            gap = vectors - centroids[place[owner]]
            yield pa.RecordBatch.from_arrays([ids, pa.array(owner[of].astype(np.int32)), pa.array(np.einsum("ij,ij->i", gap, gap)[of])], ["id", "cluster", "distance"])

    return run


def dual_tree_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Exact Lloyd clusters of the vectors: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Components become floor(scale * x). Vectors that are null, have another length than `dim`, or hold a null or non-finite
    component are left out. Centroids start as the `k` vectors with the smallest sha256 of seed and id (all, if there are fewer;
    equal hashes by the vector); a round replaces each by the floor of its vectors' mean, and an empty one stays. Rows that
    repeat an id or a vector count each; rows without an id take part, hashed as an empty id; other columns, whatever their
    names, take no part. Without vectors there are no rows. A scaled component beyond 2**27 is an error. The driver and each
    task hold the k centroids: k is a parameter and does not grow with the data. Trees are written once to the shared folder.
    """
    spark = vectors.sparkSession
    folder = scratch(spark)
    kind = dict(vectors.dtypes)[id_col]
    rows = whole_vectors(vectors, id_col, vector_col, scale).filter(F.size("v") == dim)
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centroids = [r["v"] for r in rows.orderBy(key, "v").limit(k).select("v").collect()]
    if not centroids:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = stage(rows.mapInArrow(_planter(dim), _TREE), f"{folder}/trees")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(_centroid_tree(centroids))
        sums = trees.mapInArrow(_summer(shared, len(centroids), dim), "cluster int, n long, sums array<long>")
        each = sums.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        moved: dict[int, list[int]] = defaultdict(lambda: [0] * dim)
        for r in each.collect():  # k * dim rows
            moved[r["cluster"]][r["i"]] = r["x"] // r["n"]
        centroids = [moved.get(c, old) for c, old in enumerate(centroids)]
        shared.unpersist()
    shared = spark.sparkContext.broadcast(_centroid_tree(centroids))
    assigned = stage(trees.mapInArrow(_assigner(shared, dim), f"id {kind}, cluster int, distance long"), f"{folder}/assigned")
    shared.unpersist()
    inertia = {r["cluster"]: r["x"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("x")).collect()}  # k rows
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    told = [(c, x, sum(inertia.values()), digest(centroids[c])) for c, x in inertia.items()]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.withColumnRenamed("id", "vec_id").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
