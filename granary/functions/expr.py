"""Scalar expressions: a small typed tree that binds to a schema and lowers to a Column.

The tree exists so that names and types can be checked with the engine's own
errors before Spark sees the plan; evaluation is entirely Catalyst's.
"""

from __future__ import annotations

import datetime as dt
import operator
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary import types as G
from granary.errors import BindError


@dataclass(frozen=True)
class Bound:
    """A lowered expression: its Column, its type, and whether it is a literal."""

    column: Column
    dtype: T.DataType
    literal: bool = False


class Expr:
    """Base class; Python operators build larger expressions."""

    def bind(self, schema: T.StructType, strict: bool = False) -> Bound:
        raise NotImplementedError

    def _binary(self, kind: type, op: str, other: Any) -> Expr:
        return kind(op, self, other if isinstance(other, Expr) else lit(other))

    def __add__(self, other: Any) -> Expr:
        return self._binary(Arith, "+", other)

    def __sub__(self, other: Any) -> Expr:
        return self._binary(Arith, "-", other)

    def __mul__(self, other: Any) -> Expr:
        return self._binary(Arith, "*", other)

    def __radd__(self, other: Any) -> Expr:
        return lit(other) + self

    def __rsub__(self, other: Any) -> Expr:
        return lit(other) - self

    def __rmul__(self, other: Any) -> Expr:
        return lit(other) * self

    def __eq__(self, other: Any) -> Expr:  # type: ignore[override]
        return self._binary(Compare, "=", other)

    def __ne__(self, other: Any) -> Expr:  # type: ignore[override]
        return self._binary(Compare, "<>", other)

    def __lt__(self, other: Any) -> Expr:
        return self._binary(Compare, "<", other)

    def __le__(self, other: Any) -> Expr:
        return self._binary(Compare, "<=", other)

    def __gt__(self, other: Any) -> Expr:
        return self._binary(Compare, ">", other)

    def __ge__(self, other: Any) -> Expr:
        return self._binary(Compare, ">=", other)

    __hash__ = object.__hash__

    def __and__(self, other: Any) -> Expr:
        return self._binary(Logic, "AND", other)

    def __or__(self, other: Any) -> Expr:
        return self._binary(Logic, "OR", other)

    def __invert__(self) -> Expr:
        return Not(self)

    def between(self, low: Any, high: Any) -> Expr:
        return (self >= low) & (self <= high)

    def alias(self, name: str) -> Named:
        return Named(self, name)


@dataclass(frozen=True, eq=False)
class Named:
    """An expression with an output name."""

    expr: Expr
    name: str


@dataclass(frozen=True, eq=False)
class Literal(Expr):
    value: Any

    def bind(self, schema: T.StructType, strict: bool = False) -> Bound:
        v = self.value
        if v is None:
            return Bound(F.lit(None), T.NullType(), True)
        if isinstance(v, bool):
            return Bound(F.lit(v), G.BOOL, True)
        if isinstance(v, int):
            if not -(2**63) <= v < 2**63:
                raise BindError(f"integer literal {v} is out of range")
            kind = G.INT32 if -(2**31) <= v < 2**31 else G.INT64
            return Bound(F.lit(v).cast(kind), kind, True)
        if isinstance(v, float):
            return Bound(F.lit(v), G.DOUBLE, True)
        if isinstance(v, dt.date):
            return Bound(F.lit(v), G.DATE, True)
        if isinstance(v, str):
            return Bound(F.lit(v), G.VARCHAR, True)
        raise BindError(f"no literal of type {type(v).__name__}")


@dataclass(frozen=True, eq=False)
class Ref(Expr):
    """A column, optionally qualified; the qualifier must be a known relation name."""

    name: str
    qualifier: str | None = None

    def bind(self, schema: T.StructType, strict: bool = False) -> Bound:
        hits = [f for f in schema.fields if f.name.lower() == self.name.lower()]
        if not hits:
            raise BindError(f"no column {self.name}; there are {', '.join(schema.names)}")
        if len(hits) > 1:
            raise BindError(f"column {self.name} is ambiguous")
        return Bound(F.col("`" + hits[0].name.replace("`", "``") + "`"), hits[0].dataType)


_ARITH: dict[str, Callable] = {"+": operator.add, "-": operator.sub, "*": operator.mul}
_COMPARE: dict[str, Callable] = {
    "=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
}


def _is(kind: T.DataType, *classes: type) -> bool:
    return isinstance(kind, (*classes, T.NullType))


@dataclass(frozen=True, eq=False)
class Arith(Expr):
    op: str
    left: Expr
    right: Expr

    def bind(self, schema: T.StructType, strict: bool = False) -> Bound:
        a, b = self.left.bind(schema, strict), self.right.bind(schema, strict)
        literal = a.literal and b.literal
        if isinstance(a.dtype, T.DateType) or isinstance(b.dtype, T.DateType):
            return self._dates(a, b, literal)
        if not (_is(a.dtype, *G.NUMERIC) and _is(b.dtype, *G.NUMERIC)):
            raise BindError(f"{G.name_of(a.dtype)} {self.op} {G.name_of(b.dtype)} is not defined")
        if strict and a.dtype != b.dtype and not (a.literal or b.literal):
            raise BindError(f"operands of {self.op} have types {G.name_of(a.dtype)} and {G.name_of(b.dtype)}")
        return Bound(_ARITH[self.op](a.column, b.column), _wider(a.dtype, b.dtype), literal)

    def _dates(self, a: Bound, b: Bound, literal: bool) -> Bound:
        if isinstance(a.dtype, T.DateType) and _is(b.dtype, *G.INTEGRAL) and self.op in "+-":
            move = F.date_add if self.op == "+" else F.date_sub
            return Bound(move(a.column, b.column.cast("int")), G.DATE, literal)
        if self.op == "+" and _is(a.dtype, *G.INTEGRAL):
            return Bound(F.date_add(b.column, a.column.cast("int")), G.DATE, literal)
        raise BindError(f"{G.name_of(a.dtype)} {self.op} {G.name_of(b.dtype)} is not defined")


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    order = [T.NullType, *G.NUMERIC]
    return max((a, b), key=lambda t: order.index(type(t)))


@dataclass(frozen=True, eq=False)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr

    def bind(self, schema: T.StructType, strict: bool = False) -> Bound:
        a, b = self.left.bind(schema, strict), self.right.bind(schema, strict)
        a, b = _as_date(a, b), _as_date(b, a)
        groups = (G.NUMERIC, G.TEMPORAL, (T.StringType,), (T.BooleanType,))
        if not any(_is(a.dtype, *g) and _is(b.dtype, *g) for g in groups):
            raise BindError(f"cannot compare {G.name_of(a.dtype)} with {G.name_of(b.dtype)}")
        if strict and a.dtype != b.dtype and not (a.literal or b.literal):
            raise BindError(f"operands of {self.op} have types {G.name_of(a.dtype)} and {G.name_of(b.dtype)}")
        return Bound(_COMPARE[self.op](a.column, b.column), G.BOOL, a.literal and b.literal)


def _as_date(x: Bound, other: Bound) -> Bound:
    """A string literal that meets a date becomes a date."""
    if x.literal and isinstance(x.dtype, T.StringType) and isinstance(other.dtype, G.TEMPORAL):
        return Bound(x.column.cast("date"), G.DATE, True)
    return x


@dataclass(frozen=True, eq=False)
class Logic(Expr):
    op: str
    left: Expr
    right: Expr

    def bind(self, schema: T.StructType, strict: bool = False) -> Bound:
        a, b = self.left.bind(schema, strict), self.right.bind(schema, strict)
        for x in (a, b):
            if not _is(x.dtype, T.BooleanType):
                raise BindError(f"{self.op} needs BOOL, not {G.name_of(x.dtype)}")
        a, b = (x.column.cast("boolean") for x in (a, b))
        return Bound(a & b if self.op == "AND" else a | b, G.BOOL)


@dataclass(frozen=True, eq=False)
class Not(Expr):
    operand: Expr

    def bind(self, schema: T.StructType, strict: bool = False) -> Bound:
        x = self.operand.bind(schema, strict)
        if not _is(x.dtype, T.BooleanType):
            raise BindError(f"NOT needs BOOL, not {G.name_of(x.dtype)}")
        return Bound(~x.column.cast("boolean"), G.BOOL)


def col(name: str) -> Ref:
    """A column by name; "t.c" is qualified."""
    qualifier, _, last = name.rpartition(".")
    return Ref(last, qualifier or None)


def lit(value: Any) -> Literal:
    return Literal(value)


def date(text: str) -> Literal:
    """DATE 'YYYY-MM-DD'; a date that does not exist is an error."""
    try:
        if len(text) != 10:
            raise ValueError
        return Literal(dt.date.fromisoformat(text))
    except ValueError:
        raise BindError(f"not a date: {text!r}") from None
