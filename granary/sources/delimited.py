"""Strict typed loading of delimited text: no quoting, no inference, first bad row fails the load.

Lines are read as single strings by Spark's splittable reader and typed with
built-in expressions, so a load scales with the number of splits. One eager
pass looks at every field; it stops the load with a LoadError that names the
column and shows the line.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary import types as G
from granary.errors import BindError, IoError, LoadError

# Spellings of the two boolean values that a field may have.
TRUE_TEXT = ("1", "t", "T", "true", "TRUE")
FALSE_TEXT = ("0", "f", "F", "false", "FALSE")

#: A separator that no line holds, so that Spark's reader, which skips headers, takes each line whole.
_NOWHERE = "\u0001\u0002granary\u0002\u0001"

_INTEGER = r"^-?[0-9]+$"
_REAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


@dataclass(frozen=True)
class DelimitedOptions:
    delimiter: str = ","
    has_header: bool = False
    null_token: str = ""
    trailing_delimiter: bool = False


CSV = DelimitedOptions()
TBL = DelimitedOptions(delimiter="|", trailing_delimiter=True)


def load_delimited(spark: SparkSession, path: str, schema: T.StructType, options: DelimitedOptions = CSV) -> DataFrame:
    """Reads files; with has_header the first line of each is skipped and not used for names."""
    reader = spark.read.schema("value string").options(
        sep=_NOWHERE, quote="", escape="", header=options.has_header, mode="PERMISSIVE"
    )
    try:
        lines = reader.csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise IoError(f"cannot open {path}") from None
        raise
    return _typed(lines, schema, options)


def load_lines(
    spark: SparkSession, lines: Iterable[str], schema: T.StructType, options: DelimitedOptions = CSV
) -> DataFrame:
    """The same for lines held by the caller, such as an open stream; small inputs only."""
    rows = [(x.rstrip("\n"),) for x in lines]
    return _typed(spark.createDataFrame(rows[1:] if options.has_header else rows, "value string"), schema, options)


def load_frame(lines: DataFrame, schema: T.StructType, options: DelimitedOptions = CSV) -> DataFrame:
    """The same for lines in the first column of a DataFrame, without headers."""
    return _typed(lines.select(F.col(lines.columns[0]).alias("value")), schema, options)


def _typed(lines: DataFrame, schema: T.StructType, options: DelimitedOptions) -> DataFrame:
    if not options.delimiter:
        raise BindError("the delimiter is empty")
    lines = lines.select(_once(F.regexp_replace("value", r"\r$", "")).alias("value")).filter(F.length("value") > 0)
    text = F.col("value")
    if options.trailing_delimiter:
        text = F.regexp_replace(text, re.escape(options.delimiter) + "$", "")
    parts = lines.select("value", _once(F.split(text, re.escape(options.delimiter), -1)).alias("f"))
    fields = [_field(F.get("f", F.lit(k)), f.dataType, options.null_token) for k, f in enumerate(schema.fields)]
    wrong = F.when(F.size("f") != len(schema), F.lit(f"expected {len(schema)} fields"))
    for f, (_, bad) in zip(schema.fields, fields, strict=True):
        wrong = wrong.when(bad, F.lit(f"column {f.name}: not {G.name_of(f.dataType)}"))
    bad = parts.select(_once(wrong).alias("why"), "value").filter("why is not null")
    placed = bad.withColumn("place", F.monotonically_increasing_id())
    (first,) = placed.agg(F.min_by(F.struct("why", "value"), "place")).first()
    if first:
        raise LoadError(f"{first['why']}, in line {first['value']!r}")
    return parts.select(*[v.alias(f.name) for f, (v, _) in zip(schema.fields, fields, strict=True)])


def _once(value: Column) -> Column:
    """The same value from a generator, which Catalyst computes once a row: it copies a column into each of its uses."""
    return F.explode(F.array(value))


def _field(raw: Column, kind: T.DataType, null_token: str) -> tuple[Column, Column]:
    """The value of a field, and whether it is malformed."""
    null = raw == null_token
    if isinstance(kind, T.StringType):
        value = raw
    elif isinstance(kind, T.BooleanType):
        value = F.when(raw.isin(*TRUE_TEXT), True).when(raw.isin(*FALSE_TEXT), False)
    else:
        form = _DATE if isinstance(kind, T.DateType) else _REAL if isinstance(kind, T.DoubleType) else _INTEGER
        value = F.when(raw.rlike(form), raw.try_cast(kind))
    return F.when(~null, value), ~null & value.isNull()
