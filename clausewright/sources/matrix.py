"""Embeddings that were made elsewhere: a manifest in JSON and matrices in numpy's format, joined to rows by position."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import npy
from .npy import ManifestError
from .store import GateError, manifest_problems


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest; None where there is no file, ManifestError where it holds no JSON."""
    try:
        found = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    try:
        return json.loads(found["value"] if found else "")
    except ValueError as e:
        raise ManifestError(f"{path} holds no JSON") from e


def read_matrix(spark: SparkSession, path: str, range_bytes: int = npy.RANGE_BYTES) -> DataFrame:
    """(pos, embedding) of one matrix file or a folder of them, in the order of their names; positions count from 0 over all. A task reads about `range_bytes`."""
    npy.register(spark)
    return spark.read.format("matrix").option("rangeBytes", range_bytes).load(path)


def matrix_shape(path: str) -> tuple[int, int] | None:
    """(rows, dim) of one matrix file or a folder of them by their headers; None where there is none, ManifestError where they differ in width."""
    found = npy.headers(path)
    if not found:
        return None
    if len({m.dim for m in found}) > 1:
        raise ManifestError(f"the matrices of {path} differ in width")
    return sum(m.rows for m in found), found[0].dim


def cache_state(given: dict | None, exists: bool, sha1: str, model: str, count: int, dim: int | None = None) -> tuple[bool, list[str]]:
    """Whether embeddings that are there may be used again, and what speaks against it."""
    problems = ([] if exists else ["matrix missing"]) + manifest_problems(given, sha1, model, count, dim)
    return not problems, problems


def with_vectors(rows: DataFrame, manifest: dict | None, matrix: str, sha1: str, model: str, dim: int | None = None) -> DataFrame:
    """`rows` (pos, from 0 without gaps) with `embedding`, joined by position; GateError where manifest, matrix and rows do not belong together. The matrix's shape comes from its headers, the rows are looked through once."""
    count, low, high, different = rows.agg(F.count(F.lit(1)), F.min("pos"), F.max("pos"), F.count_distinct("pos")).first()
    if problems := manifest_problems(manifest, sha1, model, count, dim):
        raise GateError("; ".join(problems))
    shape = matrix_shape(matrix)
    if shape is None:
        raise GateError("matrix missing")
    if shape != (count, manifest["dim"]):
        raise GateError("the matrix has another shape than the manifest")
    if count and (low, high, different) != (0, count - 1, count):
        raise GateError("positions of the rows are not those of the matrix")
    return rows.join(read_matrix(rows.sparkSession, matrix), "pos")
