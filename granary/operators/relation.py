"""Relational operators as a fluent wrapper: each call returns a new lazy plan."""

from __future__ import annotations

from itertools import count

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.errors import BindError
from granary.functions import Aggregate, Expr, col
from granary.functions.expr import Named, Ref
from granary.operators.folded import Joined, folded
from granary.result import Result


@dataclass(frozen=True)
class Order:
    """One sort key. Nulls come last in both directions unless asked otherwise."""

    key: str
    descending: bool = False
    nulls_first: bool = False

    def column(self, c: Column) -> Column:
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


class Relation:
    """A DataFrame with the engine's names, types, null order and errors."""

    def __init__(
        self, df: DataFrame, strict: bool = False, extended: bool = False, joined: Joined | None = None
    ) -> None:
        self.df, self.strict, self.extended, self.joined = df, strict, extended, joined

    def _with(self, df: DataFrame, joined: Joined | None = None) -> Relation:
        return Relation(df, self.strict, self.extended, joined)

    def _bind(self, expr: Expr) -> Column:
        return expr.bind(self.df.schema, self.strict).column

    def filter(self, predicate: Expr) -> Relation:
        """Keeps the rows for which the predicate is TRUE; NULL does not pass."""
        bound = predicate.bind(self.df.schema, self.strict)
        if bound.dtype.typeName() not in ("boolean", "void"):
            raise BindError("WHERE needs a BOOL expression")
        return self._with(self.df.filter(bound.column.cast("boolean")))

    def project(self, *items: Expr | Named | str) -> Relation:
        """One output column per item; an unnamed expression at position k is called expr<k>."""
        return self._with(self.df.select(*[self._bind(e).alias(n) for e, n in _named(items)]))

    def aggregate(self, keys: list[Expr | Named | str] | None = None, aggs: list[Aggregate] | None = None) -> Relation:
        """Groups by keys (NULL is one group); without keys, exactly one row comes out.

        Without aggregates the distinct keys remain. A name given twice gets _1, _2 and so on.
        Right after joins, the inputs are grouped before they are joined.
        """
        keys, aggs = keys or [], aggs or []
        if not keys and not aggs:
            raise BindError("an aggregate needs keys or functions")
        named = _named(keys)
        names = unique([n for _, n in named] + [a.name or a.default_name for a in aggs])
        group = [self._bind(e).alias(n) for (e, _), n in zip(named, names, strict=False)]
        df, out = self.df, [a.bind(self.df.schema, self.strict, self.extended) for a in aggs]
        if self.joined is not None:
            df, out = folded(self, [e for e, _ in named], aggs) or (df, out)
        if not aggs:
            return self._with(df.select(*group).distinct())
        out = [c.alias(n) for c, n in zip(out, names[len(group) :], strict=True)]
        return self._with(df.groupBy(*group).agg(*out) if group else df.agg(*out))

    def order_by(self, *orders: Order | str) -> Relation:
        keys = [o if isinstance(o, Order) else Order(o) for o in orders]
        return self._with(self.df.orderBy(*[o.column(self._bind(col(o.key))) for o in keys]))

    def limit(self, n: int) -> Relation:
        return self._with(self.df.limit(n))

    def top_n(self, n: int, *orders: Order | str) -> Relation:
        """order_by then limit: Spark keeps n rows per task and merges those."""
        return self.order_by(*orders).limit(n)

    def join(self, build: Relation, keys: list[tuple[str, str]], broadcast: bool = False) -> Relation:
        """Inner equi-join; the output has the left columns, then the right ones, both keys kept.

        NULL keys match nothing. broadcast is for a build side of known small size; otherwise
        Spark chooses from statistics and AQE. A right column whose name is taken gets _r, or _r2 and so on.
        """
        if not keys:
            raise BindError("a join needs keys")
        taken = {c.lower() for c in self.df.columns}
        free = {c.lower() for c in build.df.columns} | taken
        right_names = {}
        for c in build.df.columns:
            right_names[c] = c
            if c.lower() in taken:
                suffixes = (f"_r{k}" if k > 1 else "_r" for k in count(1))
                right_names[c] = next(c + x for x in suffixes if (c + x).lower() not in free)
                free.add(right_names[c].lower())
        right = build.df.select(*[F.col(f"`{c}`").alias(n) for c, n in right_names.items()])
        condition, pairs = None, []
        for left, other in keys:
            a, b = col(left).bind(self.df.schema), col(other).bind(build.df.schema)
            if self.strict and a.dtype != b.dtype:
                raise BindError(f"join keys {left} and {other} differ in type")
            name = next(n for c, n in right_names.items() if c.lower() == col(other).name.lower())
            one = self.df[col(left).name] == right[name]
            condition = one if condition is None else condition & one
            pairs.append((next(c for c in self.df.columns if c.lower() == col(left).name.lower()), name))
        joined = Joined(self, build, right_names, pairs, broadcast)
        return self._with(self.df.join(F.broadcast(right) if broadcast else right, condition, "inner"), joined)

    def collect(self) -> Result:
        return Result(self.df.schema, self.df.collect())

    def discard(self) -> None:
        """Runs the plan and drops its rows, as a benchmark sink."""
        self.df.write.format("noop").mode("overwrite").save()


def _named(items: list | tuple) -> list[tuple[Expr, str]]:
    out = []
    for k, x in enumerate(items):
        x = col(x) if isinstance(x, str) else x
        out.append((x.expr, x.name) if isinstance(x, Named) else (x, x.name if isinstance(x, Ref) else f"expr{k}"))
    return out


def unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n.lower(), 0)
        seen[n.lower()] = k + 1
        out.append(f"{n}_{k}" if k else n)
    return out
