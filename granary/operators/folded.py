"""Aggregates over joins without the joined rows.

A key that repeats on both sides of a join makes as many rows as the product of
its repeats. An aggregate needs only how often each combination occurs, so each
input is grouped by the columns that the joins and the result use, with its
number of rows, and the numbers are multiplied where inputs meet.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import Aggregate, Expr
from granary.functions.expr import Ref

# Types whose sums over an input alone cannot overflow, so that no row without a match can fail the query.
_SUMMED = (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)


@dataclass(frozen=True)
class Joined:
    """What a join was made of: two relations, the output names of the right columns, and key pairs by output name."""

    left: Any
    right: Any
    right_names: dict[str, str]
    keys: list[tuple[str, str]]
    broadcast: bool


def folded(relation: Any, keys: list[Expr], aggs: list[Aggregate]) -> tuple[DataFrame, list[Column]] | None:
    """A frame with the columns of the keys, and the aggregates over it; None where only the joined rows will do."""
    schema = relation.df.schema
    by_lower = {c.lower(): c for c in schema.names}
    types = [a.expr.bind(schema, relation.strict).dtype if a.expr is not None else None for a in aggs]
    if len(by_lower) < len(schema) or any(
        a.func in ("sum", "avg") and isinstance(t, T.DecimalType) for a, t in zip(aggs, types, strict=True)
    ):
        return None
    prefix = "_"
    while any(c.startswith(prefix) for c in by_lower):
        prefix += "_"
    keep = {by_lower[c] for e in keys for c in _refs(e)}
    early: list[tuple[str, str, str]] = []
    out = []
    n = F.col(f"{prefix}n")
    for k, (a, kind) in enumerate(zip(aggs, types, strict=True)):
        if a.expr is None:
            out.append(_total(n))
            continue
        plain = isinstance(a.expr, Ref) and by_lower[a.expr.name.lower()]
        parts = {"avg": ("sum", "count")}.get(a.func, (a.func,))
        if plain and ("sum" not in parts or isinstance(kind, _SUMMED)):
            early += [(f"{prefix}{k}{p}", p, plain) for p in parts]
            one = {p: F.col(f"{prefix}{k}{p}") for p in parts}
        else:
            keep |= {by_lower[c] for c in _refs(a.expr)}
            x = a.expr.bind(schema, relation.strict).column
            wide = x.cast("double" if a.func == "avg" or isinstance(kind, (T.FloatType, T.DoubleType)) else "bigint")
            one = {"count": F.when(x.isNotNull(), n), "sum": wide * n, "min": x, "max": x}
        if a.func == "avg":
            out.append(F.try_divide(F.sum(one["sum"].cast("double")), F.sum(one["count"])))
        else:
            out.append({"sum": F.sum, "count": _total, "min": F.min, "max": F.max}[a.func](one[a.func]))
    return _fold(relation, {c: c for c in schema.names}, keep, early, prefix), out


def _total(n: Column) -> Column:
    return F.coalesce(F.sum(n), F.lit(0).cast("bigint"))


def _fold(r: Any, names: dict[str, str], keep: set[str], early: list[tuple[str, str, str]], prefix: str) -> DataFrame:
    """The columns to keep, how many rows each row stands for, and aggregates of columns over those rows."""
    n = f"{prefix}n"
    if r.joined is None:
        df = r.df.select(*[F.col(_quoted(c)).alias(o) for c, o in names.items()])
        make = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
        made = [make[func](F.col(_quoted(c))).alias(p) for p, func, c in early]
        return df.groupBy(*[F.col(_quoted(c)) for c in sorted(keep)]).agg(F.count(F.lit(1)).alias(n), *made)
    j = r.joined
    pairs = [(names[a], names[b]) for a, b in j.keys]
    sides = []
    for side, own, wanted, mark in (
        (j.left, {c: names[c] for c in j.left.df.columns}, {a for a, _ in pairs}, "l"),
        (j.right, {c: names[o] for c, o in j.right_names.items()}, {b for _, b in pairs}, "r"),
    ):
        here = set(own.values())
        part = _fold(side, own, (keep & here) | wanted, [x for x in early if x[2] in here], prefix)
        sides.append((part.withColumnRenamed(n, n + mark), here, n + mark))
    (left, on_left, n_left), (right, _, n_right) = sides
    condition = None
    for a, b in pairs:
        one = F.col(_quoted(a)) == F.col(_quoted(b))
        condition = one if condition is None else condition & one
    both = left.join(F.broadcast(right) if j.broadcast else right, condition, "inner")
    scaled = [
        (F.col(p) * F.col(n_right if c in on_left else n_left) if func in ("sum", "count") else F.col(p)).alias(p)
        for p, func, c in early
    ]
    times = (F.col(n_left) * F.col(n_right)).alias(n)
    return both.select(*[F.col(_quoted(c)) for c in sorted(keep)], times, *scaled)


def _refs(e: object) -> set[str]:
    if isinstance(e, Ref):
        return {e.name.lower()}
    return set().union(*(_refs(getattr(e, f.name)) for f in fields(e))) if isinstance(e, Expr) else set()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
