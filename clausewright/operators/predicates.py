"""Metadata predicates as nested dictionaries, compiled to one boolean column."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules as R

Where = dict


def combine(*conditions: Where | None) -> Where | None:
    """The conjunction; empty conditions fall away, one stays bare."""
    given = [c for c in conditions if c]
    return None if not given else given[0] if len(given) == 1 else {"$and": given}


def mentions(where: Where, field: str) -> bool:
    return any(key == field or key in ("$and", "$or") and any(mentions(p, field) for p in value) for key, value in where.items())


def with_default_kind(where: Where | None, kind: str = "article") -> Where:
    """Adds `kind` unless the predicate mentions kinds anywhere; a predicate that does is returned as it is."""
    if not where:
        return {"kind": kind}
    if mentions(where, "kind"):
        return where
    parts = where["$and"] if set(where) == {"$and"} else [where]
    return {"$and": [*parts, {"kind": kind}]}


def force_only(standards: list[str] | None = None, only: bool = True) -> Where | None:
    forced = [R.PRESETS["force-only"], {"kind": "article"}] if only else []
    return combine(*forced, {"standard": {"$in": list(standards)}} if standards else None)


def presets(*names: str) -> Where | None:
    return combine(*(R.PRESETS[n] for n in names))


def compile_where(where: Where | None) -> Column:
    """Fields that are null are unequal to every value, so `$ne` keeps them."""
    if not where:
        return F.lit(True)
    parts = []
    for field, value in where.items():
        if field in ("$and", "$or"):
            parts.append(reduce(and_ if field == "$and" else or_, map(compile_where, value)))
        elif isinstance(value, dict):
            for op, operand in value.items():
                if op == "$in":
                    parts.append(F.col(field).isNotNull() & F.col(field).isin(*operand))
                elif op == "$ne":
                    parts.append(~F.col(field).eqNullSafe(operand))
                elif op == "$eq":
                    parts.append(F.col(field).eqNullSafe(operand))
                else:
                    raise ValueError(f"unknown operator {op}")
        else:
            parts.append(F.col(field).eqNullSafe(value))
    return reduce(and_, parts)
