"""The aggregate functions, each with the types it accepts."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary import types as G
from granary.errors import BindError
from granary.functions.expr import Expr


@dataclass(frozen=True, eq=False)
class Aggregate:
    """func over expr (None only for COUNT(*)), with an output name."""

    func: str
    expr: Expr | None = None
    name: str | None = None

    def alias(self, name: str) -> Aggregate:
        return replace(self, name=name)

    @property
    def default_name(self) -> str:
        return "count_star" if self.expr is None else self.func

    def bind(self, schema: T.StructType, strict: bool = False, extended: bool = False) -> Column:
        """extended also allows MIN and MAX over BOOL and VARCHAR."""
        if self.expr is None:
            return F.count(F.lit(1))
        x = self.expr.bind(schema, strict)
        if self.func == "count":
            return F.count(x.column)
        allowed = G.NUMERIC
        if self.func in ("min", "max"):
            allowed += G.TEMPORAL + ((T.BooleanType, T.StringType) if extended else ())
        if not isinstance(x.dtype, allowed):
            raise BindError(f"{self.func.upper()} over {G.name_of(x.dtype)} is not supported")
        return {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[self.func](x.column)


def count_star() -> Aggregate:
    return Aggregate("count")


def count(expr: Expr) -> Aggregate:
    return Aggregate("count", expr)


def sum_(expr: Expr) -> Aggregate:
    return Aggregate("sum", expr)


def min_(expr: Expr) -> Aggregate:
    return Aggregate("min", expr)


def max_(expr: Expr) -> Aggregate:
    return Aggregate("max", expr)


def avg(expr: Expr) -> Aggregate:
    return Aggregate("avg", expr)
