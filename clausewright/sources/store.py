"""Published versions of an index in Spark's catalog.

Each version is a table of its own. The live one is what a view of the store's name selects from, and the view's properties
are its manifest; so publishing is one CREATE OR REPLACE VIEW, and whatever fails before it leaves the old version live.
The catalog is the session's: a shared metastore on a cluster.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.search import self_hits

PREFIX = "clausewright."


class GateError(RuntimeError):
    """The embeddings do not belong to the rows; nothing was written."""

    exit_code = 3


class PublishError(RuntimeError):
    """The new version could not be verified; the old one is still live."""

    exit_code = 4


@dataclass(frozen=True)
class Manifest:
    sha1: str
    model: str
    dim: int
    count: int


def manifest_problems(given: dict | None, sha1: str, model: str, count: int, dim: int | None = None) -> list[str]:
    """What speaks against using embeddings whose manifest is `given` for rows of this fingerprint, model and count."""
    if not isinstance(given, dict):
        return ["manifest missing"]
    missing = [f for f in ("sha1", "model", "dim", "count", "shape") if f not in given]
    if missing:
        return [f"fields missing: {', '.join(missing)}"]
    out = [f"{name} differs" for name, want in (("sha1", sha1), ("model", model), ("count", count)) if given[name] != want]
    whole = isinstance(given["dim"], int) and not isinstance(given["dim"], bool)
    if not whole:
        out.append("dim is no integer")
    shape = given["shape"]
    if not isinstance(shape, (list, tuple)) or len(shape) != 2:
        out.append("shape is no pair")
    elif list(shape) != [given["count"], given["dim"]]:
        out.append("shape differs from count and dim")
    if whole and dim is not None and given["dim"] != dim:
        out.append("dim differs from the setting")
    return out


def model_of(given: dict | None) -> str | None:
    """The model that a manifest names; None for a blank one."""
    return ((given or {}).get("model") or "").strip() or None


class IndexStore:
    def __init__(self, spark: SparkSession, name: str, database: str = "default"):
        self.spark, self.name, self.database = spark, name, database

    def _at(self, name: str) -> str:
        return f"`{self.database}`.`{name}`"

    def _properties(self, name: str) -> dict[str, str]:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self._at(name)}").filter(F.startswith("key", F.lit(PREFIX))).collect()
        return {r["key"].removeprefix(PREFIX): r["value"] for r in rows}

    def live(self) -> dict | None:
        """The live version's manifest; None before the first."""
        if not self.spark.catalog.tableExists(self._at(self.name)):
            return None
        now = self._properties(self.name)
        return now | {"dim": int(now["dim"]), "count": int(now["count"])}

    def problems(self, model: str | None = None, dim: int | None = None, sha1: str | None = None) -> list[str]:
        """What speaks against reading the live version with these; what is not given is not compared, nor a fingerprint that the version lacks."""
        now = self.live()
        if now is None:
            return ["nothing published"]
        out = []
        if model is not None and model_of(now) != model:
            out.append("model differs" if model_of(now) else "model missing")
        if dim is not None and now["dim"] != dim:
            out.append("dim differs")
        if sha1 and now["sha1"] and now["sha1"] != sha1:
            out.append("sha1 differs")
        return out

    def open(self, model: str | None = None, dim: int | None = None, sha1: str | None = None) -> DataFrame:
        """The live version's rows; GateError where it was made by another model, has another width or holds other rows."""
        if problems := self.problems(model, dim, sha1):
            raise GateError("; ".join(problems))
        return self.spark.table(self._at(self.name))

    def verify(self, rows: DataFrame, want: Manifest, sample: int = 3) -> list[str]:
        """Problems of written rows: count, width, and the first rows' own vectors not finding them."""
        n, narrow, wide = rows.agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        out = [] if n == want.count else [f"{n} rows, not {want.count}"]
        if n and (narrow, wide) != (want.dim, want.dim):
            out.append("dim differs")
        looked = min(max(1, sample), n, 10)
        if not out and n and self_hits(rows, looked).filter("is_self").count() < looked:  # a vector without a score finds nothing
            out.append("a row does not find itself")
        return out

    def _point(self, manifest: dict) -> None:
        text = lambda v: "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
        properties = ", ".join(f"{text(PREFIX + k)} = {text(v)}" for k, v in manifest.items())
        self.spark.sql(f"CREATE OR REPLACE VIEW {self._at(self.name)} TBLPROPERTIES ({properties}) AS SELECT * FROM {self._at(manifest['version'])}")

    def publish(self, rows: DataFrame, want: Manifest, given: dict, sample: int = 3, max_records: int = 0, at: Callable[[str], None] = lambda step: None) -> str:
        """Gate, write, verify, then point the view at the new version. Returns the version's name.

        `at` is called behind each step (written, verified, published). If it raises or the live rows cannot be counted again,
        the version that was live before is live afterwards.
        """
        if problems := manifest_problems(given, want.sha1, want.model, want.count, want.dim):
            raise GateError("; ".join(problems))
        before = self.live()
        version, seen = f"{self.name}_v{time.time_ns()}", Observation()
        counted = rows.observe(seen, F.count(F.lit(1)).alias("n"))  # the rows are made once, and counted as they are written
        writer = counted.write.format("parquet").mode("errorifexists")
        (writer.option("maxRecordsPerFile", max_records) if max_records else writer).saveAsTable(self._at(version))
        if (n := seen.get["n"]) != want.count:
            self.spark.sql(f"DROP TABLE {self._at(version)}")
            raise GateError(f"{n} rows, not {want.count}")
        at("written")
        if problems := self.verify(self.spark.table(self._at(version)), want, sample):
            raise PublishError("; ".join(problems))
        at("verified")
        self._point(asdict(want) | {"version": version, "created": time.time_ns() // 1_000_000_000})
        try:
            at("published")
            if (n := self.spark.table(self._at(self.name)).count()) != want.count:
                raise PublishError(f"{n} live rows, not {want.count}")
        except Exception:
            if before is None:
                self.spark.sql(f"DROP VIEW {self._at(self.name)}")
            else:
                self._point(before)
            raise
        self.spark.sql(f"ALTER TABLE {self._at(version)} SET TBLPROPERTIES ('{PREFIX}published' = 'true')")
        return version

    def vacuum(self, keep: int = 1) -> list[str]:
        """Drops versions but the live one and the `keep` published last before it, unpublished ones too, and returns their names. For a time when nothing is being published."""
        now = self.live()
        names = {r["tableName"] for r in self.spark.sql(f"SHOW TABLES IN `{self.database}` LIKE '{self.name}_v*'").collect()}
        versions = sorted(n for n in names if n.removeprefix(f"{self.name}_v").isdigit())
        older = [n for n in versions if now is None or n < now["version"]]
        published = [n for n in older if "published" in self._properties(n)]
        kept = {*published[len(published) - keep :], *([now["version"]] if now else [])} if keep else {now["version"]} if now else set()
        gone = [n for n in versions if n not in kept]
        for n in gone:
            self.spark.sql(f"DROP TABLE {self._at(n)}")
        return gone


def row_payload(rows: DataFrame, clean: Callable[[str, Column], Column] | None = None, leave: tuple[str, ...] = ("id", "text", "embedding")) -> DataFrame:
    """(id, text, meta): what a store keeps of a row beside its vector. `meta` has all columns but those in `leave`, each as `clean(name, column)` gives it; by default, missing texts become empty."""
    kinds = dict(rows.dtypes)
    plain = lambda name, column: F.coalesce(column, F.lit("")) if kinds[name] == "string" else column
    meta = [(clean or plain)(c, F.col(f"`{c}`")).alias(c) for c in rows.columns if c not in leave]
    return rows.select("id", "text", F.struct(*meta).alias("meta"))


def store_by_question(df: DataFrame, table: str, buckets: int) -> DataFrame:
    """Hits or answers (qid, ...) as a table of the catalog, in `buckets` buckets by question. Tables of as many buckets are verified, extracted from and rendered without an exchange."""
    df.repartition(buckets, "qid").write.format("parquet").bucketBy(buckets, "qid").sortBy("qid").mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)
