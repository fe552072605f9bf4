"""Whitening by a randomised range finder.

Components come from an orthonormal basis Q of a random subspace, wider than the number of components by an oversampling. A
pass over all centred rows c gives V Q = sum of c (c . Q) / n, of which Rayleigh-Ritz takes approximate components, and whose
orthonormal basis is the next Q (a power pass). Where residuals |V u - e u| are still not at rounding after the power passes,
the basis is expanded to all dimensions, and one more pass gives the components to double precision. Rows are centred before
they are multiplied: the integer part of the mean is taken off exactly, its fraction as a double below 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stage, whole_matrix, whole_vectors

OVERSAMPLE, POWER_PASSES = 10, 2
#: A residual in shares of the largest eigenvalue that passes as rounding; a smaller eigenvalue than FLAT of the largest is none.
RESIDUAL, FLAT = 1e-13, 1e-12
#: Rows that are multiplied at a time.
ROWS = 4096


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            part = batch.slice(first, ROWS)
            yield part, whole_matrix(part.column(part.schema.get_field_index("v")), dim)


def _summed(rows: DataFrame, dim: int, each: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> np.ndarray:
    """The sum over all matrices of rows of each(matrix), of `size` numbers: added up in each task, then by place."""
    dtype = np.int64 if kind == "long" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype)
        for _, x in _matrices(batches, dim):
            total += each(x).ravel()
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(total))], ["t"])

    added = rows.mapInArrow(run, f"t array<{kind}>").select(F.posexplode("t").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    out = np.zeros(size, dtype)
    for r in added.collect():  # `size` rows, whatever the number of vectors
        out[r["i"]] = r["x"]
    return out


def components(apply: Callable[[np.ndarray], np.ndarray], dim: int, count: int, oversample: int = OVERSAMPLE, passes: int = POWER_PASSES, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix V, by falling eigenvalue, of which `apply` gives V Q."""
    rng = np.random.default_rng(seed)
    width = min(dim, count + oversample)
    basis = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    while True:
        for _ in range(passes if width < dim else 1):
            image = apply(basis)
            small = basis.T @ image
            values, turn = np.linalg.eigh((small + small.T) / 2)
            values, turn = values[::-1][:count], turn[:, ::-1][:, :count]
            vectors = basis @ turn
            residual = np.linalg.norm(image @ turn - vectors * values, axis=0).max(initial=0)
            if width == dim or residual <= RESIDUAL * max(values[0], 0):
                return values, vectors / np.linalg.norm(vectors, axis=0)
            basis = np.linalg.qr(image)[0]
        width = dim
        basis = np.linalg.qr(np.hstack([basis, rng.standard_normal((dim, dim - basis.shape[1]))]))[0]


def _deviation(x: np.ndarray, n: int, total: np.ndarray, whole: np.ndarray) -> pa.Array:
    """Sums of (n * x - total) ** 2 over the dimensions, exact; null where they do not fit a long."""
    near, rest = x - whole, total - n * whole  # n * x - total = n * near - rest
    if x.shape[1] * (float(n) * (np.abs(near).max(initial=0) + 1)) ** 2 < 2**62:
        return pa.array(((n * near - rest.astype(np.int64)) ** 2).sum(axis=1))
    exact = ((n * near.astype(object) - rest) ** 2).sum(axis=1)
    return pa.array([d if d < 2**63 else None for d in exact], pa.int64())


def whiten(vectors: DataFrame, count: int = 16, scale: int = 64, add: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding", oversample: int = OVERSAMPLE, passes: int = POWER_PASSES) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    x = floor(scale * c) + add of each component c. The fit is over distinct x: n of them, with sums S and covariance V (divisor
    n). deviation is the sum of (n * x - S) ** 2 over the dimensions (null beyond a long), whitened the projection of x - S / n
    on the component over the root of its eigenvalue, explained the eigenvalue's share of the trace, identity_error the largest
    absolute entry of whitened's covariance over the fit less the identity, measured in a pass of its own.

    Null and empty vectors, and such as hold a null or non-finite component, are left out, as are vectors of another length
    than the most frequent (of as frequent ones, the longest). Rows that repeat an id or a vector have their rows each; rows
    without an id have a null vec_id; other columns, whatever their names, take no part. Components of an eigenvalue of 0 (to
    rounding: below 1e-12 of the largest), on which nothing can be whitened, have no rows: a table of one distinct vector, or
    of none, gives no row.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_col]
    out = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_vectors(vectors, id_col, vector_col, scale, add)
    most = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if most is None:
        return spark.createDataFrame([], out)
    dim = most["size"]
    rows = rows.filter(F.size("v") == dim)
    fit = stage(rows.select("v").distinct(), f"{scratch(spark)}/distinct")

    sums = _summed(fit, dim, lambda x: np.append(x.sum(axis=0), len(x)), dim + 1, "long")
    total, n = np.array(sums[:-1].tolist(), object), int(sums[-1])
    whole = np.array([int(s) // n for s in total], np.int64)
    part = np.array([float(int(s) - n * int(m)) / n for s, m in zip(total, whole, strict=True)])
    centred = lambda x: (x - whole).astype(float) - part
    trace = float(_summed(fit, dim, lambda x: np.array([(centred(x) ** 2).sum()]), 1)[0]) / n

    def apply(basis: np.ndarray) -> np.ndarray:
        image = _summed(fit, dim, lambda x: (c := centred(x)).T @ (c @ basis), basis.size)
        return image.reshape(basis.shape) / n

    values, axes = components(apply, dim, min(count, dim), oversample, passes)
    good = values > max(values[0], 0) * FLAT
    values, axes = values[good], axes[:, good]
    if not len(values):
        return spark.createDataFrame([], out)
    scaled = axes / np.sqrt(values)
    size = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ scaled
        return np.append((w.T @ w).ravel(), w.sum(axis=0))

    found = _summed(fit, dim, moments, size * size + size)
    mean = found[size * size :] / n
    error = float(np.abs(found[: size * size].reshape(size, size) / n - np.outer(mean, mean) - np.eye(size)).max())
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, dim):
            times = np.repeat(np.arange(len(x)), size)
            ids, off = batch.column(0).take(pa.array(times)), _deviation(x, n, total, whole).take(pa.array(times))
            fixed = lambda v: pa.array(np.full(len(times), v))
            columns = [ids, pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))), fixed(np.int64(n)), off, pa.array((centred(x) @ scaled).ravel()), pa.array(np.tile(explained, len(x))), fixed(error)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, out)
