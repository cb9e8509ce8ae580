from granary.functions.aggregates import Aggregate, avg, count, count_star, max_, min_, sum_
from granary.functions.expr import Expr, col, date, lit

__all__ = ["Aggregate", "Expr", "avg", "col", "count", "count_star", "date", "lit", "max_", "min_", "sum_"]
