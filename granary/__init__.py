"""granary: an analytical query engine expressed in Spark DataFrame plans."""

from granary.errors import BindError, EngineError, IoError, LoadError, ParseError, UnsupportedPlanError
from granary.functions import avg, col, count, count_star, lit, max_, min_, sum_
from granary.operators import Relation
from granary.session import Engine

__all__ = [
    "BindError", "Engine", "EngineError", "IoError", "LoadError", "ParseError", "Relation",
    "UnsupportedPlanError", "avg", "col", "count", "count_star", "lit", "max_", "min_", "sum_",
]
