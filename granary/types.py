"""The six column types and how they appear in Spark."""

from __future__ import annotations

from pyspark.sql import types as T

from granary.errors import BindError

BOOL, INT32, INT64 = T.BooleanType(), T.IntegerType(), T.LongType()
DOUBLE, DATE, VARCHAR = T.DoubleType(), T.DateType(), T.StringType()

_NAMES = {"BOOL": BOOL, "INT32": INT32, "INT64": INT64, "DOUBLE": DOUBLE, "DATE": DATE, "VARCHAR": VARCHAR}
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def type_of(name: str) -> T.DataType:
    """The Spark type for one of BOOL, INT32, INT64, DOUBLE, DATE, VARCHAR."""
    try:
        return _NAMES[name.upper()]
    except KeyError:
        raise BindError(f"unknown type {name}") from None


def name_of(dtype: T.DataType) -> str:
    return next((n for n, t in _NAMES.items() if t == dtype), dtype.simpleString().upper())


def schema(**columns: str) -> T.StructType:
    """schema(id="INT32", name="VARCHAR") with every field nullable."""
    return T.StructType([T.StructField(n, type_of(t), True) for n, t in columns.items()])
