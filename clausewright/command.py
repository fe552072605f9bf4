"""Commands over an index: `python -m clausewright.command publish|verify|gate|standards ...`.

They end with 0 where all is well, 1 where a check failed, 3 where embeddings do not belong to the rows (nothing was written)
and 4 where a new version could not be put live (the old one still is).
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.catalog import status_counter
from .operators.quality_gate import exit_code, gate
from .sources.chunks import CHUNKS, fingerprint, positioned_chunks
from .sources.matrix import ManifestError, read_manifest, with_vectors
from .sources.store import GateError, IndexStore, Manifest, PublishError


def publish(spark: SparkSession, args: argparse.Namespace, at: Callable[[str], None]) -> dict:
    rows = positioned_chunks(spark, args.chunks)
    given = read_manifest(spark, args.manifest)
    sha1 = fingerprint(spark, args.chunks).first()["sha1"]
    joined = with_vectors(rows, given, args.matrix, sha1, args.model, args.dim)
    want = Manifest(sha1, args.model, given["dim"], given["count"])
    version = IndexStore(spark, args.name).publish(joined.drop("pos"), want, given, args.sample, at=at)
    return {"version": version, "count": want.count, "dim": want.dim}


def checks(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """(check, status, detail) of the live version."""
    store = IndexStore(spark, args.name)
    sha1 = fingerprint(spark, args.chunks).first()["sha1"] if args.chunks else None
    out = [("manifest", p) for p in store.problems(args.model, args.dim, sha1)]
    now = store.live()
    if now is None:
        rows = [("rows", "nothing published")]
    else:
        rows = [("rows", p) for p in store.verify(store.open(), Manifest(now["sha1"], now["model"], now["dim"], now["count"]), args.sample)]
    told = [(name, "FAIL" if (found := [p for c, p in group if c == name]) else "PASS", "; ".join(found)) for name, group in (("manifest", out), ("rows", rows))]
    return spark.createDataFrame(told, "check string, status string, detail string")


def standards(spark: SparkSession, args: argparse.Namespace) -> dict:
    """How many clauses of each standard and status the live version has, the most first, and how many standards."""
    rows = [r.asDict() for r in status_counter(IndexStore(spark, args.name).open()).collect()]
    rows.sort(key=lambda r: (-r["n"], str(r["standard"]), str(r["force_status"])))
    return {"standards": len({r["standard"] for r in rows}), "clauses": sum(r["n"] for r in rows), "rows": rows}


def main(argv: list[str], spark: SparkSession | None = None, at: Callable[[str], None] = lambda step: None) -> int:
    parser = argparse.ArgumentParser(prog="clausewright", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("publish", "verify", "gate", "standards"):
        one = commands.add_parser(name)
        one.add_argument("--chunks", required=name in ("publish", "gate"), help="a file of JSON lines")
        one.add_argument("--json", action="store_true", help="print the result as JSON")
        if name != "gate":
            one.add_argument("--name", default="clauses")
        if name in ("publish", "verify"):
            one.add_argument("--model", required=name == "publish")
            one.add_argument("--dim", type=int)
            one.add_argument("--sample", type=int, default=3)
        if name == "publish":
            one.add_argument("--manifest", required=True)
            one.add_argument("--matrix", required=True)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("clausewright").getOrCreate()
    try:
        if args.command == "publish":
            told = publish(spark, args, at)
            print(json.dumps(told) if args.json else f"published {told['version']}: {told['count']} rows")
            return 0
        if args.command == "standards":
            told = standards(spark, args)
            print(json.dumps(told, ensure_ascii=False) if args.json else "\n".join([*(" ".join(map(str, r.values())) for r in told["rows"]), f"{told['standards']} standards, {told['clauses']} clauses"]))
            return 0
        found = checks(spark, args) if args.command == "verify" else gate(spark.read.schema(CHUNKS).json(args.chunks))
        rows = [r.asDict() for r in found.collect()]
        code = exit_code(found.sparkSession.createDataFrame([(r["status"],) for r in rows], "status string")).first()[0]
        print(json.dumps({"ok": code == 0, "checks": rows}, ensure_ascii=False) if args.json else "\n".join(" ".join(map(str, r.values())) for r in rows))
        return int(code)
    except (GateError, ManifestError) as e:
        print(f"refused: {e}", file=sys.stderr)
        return GateError.exit_code
    except PublishError as e:
        print(f"not published: {e}", file=sys.stderr)
        return e.exit_code
    except Exception as e:
        if args.command != "publish":
            raise
        print(f"not published: {e}", file=sys.stderr)
        return PublishError.exit_code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
