"""The engine: a catalog of named tables over its own Spark session."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from granary.errors import BindError
from granary.operators import Relation
from granary.result import Result
from granary.sources import CSV, DelimitedOptions, load_delimited


class Engine:
    """Tables by name, SQL over them, and the fluent API.

    The engine works in a newSession() of the given session, where ANSI mode is
    off: integer arithmetic and integer sums wrap, and the caller's settings
    stay as they are. Table names are exact; adding a name again replaces it.
    """

    def __init__(self, spark: SparkSession, strict_types: bool = False, extended_aggregates: bool = False) -> None:
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.ansi.enabled", "false")
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.strict, self.extended = strict_types, extended_aggregates
        self._tables: dict[str, DataFrame] = {}

    def add(self, name: str, df: DataFrame) -> None:
        """df must come from this engine's session, so that plans do not mix settings."""
        self._tables[name] = df
        df.createOrReplaceTempView(name)

    def add_parquet(self, name: str, path: str) -> None:
        self.add(name, self.spark.read.parquet(path))

    def add_directory(self, path: str, names: list[str]) -> None:
        for n in names:
            self.add_parquet(n, os.path.join(path, f"{n}.parquet"))

    def load(self, name: str, path: str, schema: T.StructType, options: DelimitedOptions = CSV) -> None:
        self.add(name, load_delimited(self.spark, path, schema, options))

    def names(self) -> list[str]:
        return sorted(self._tables)

    def table(self, name: str) -> Relation:
        if name not in self._tables:
            raise BindError(f"no table {name}")
        return Relation(self._tables[name], self.strict, self.extended)

    def sql(self, text: str) -> Relation:
        """A statement of the engine's own grammar as a lazy relation."""
        from granary.plans.lower import lower
        from granary.plans.sqltext import parse

        return lower(parse(text), self.table)

    def query(self, text: str) -> Result:
        return self.sql(text).collect()

    def spark_sql(self, text: str) -> DataFrame:
        """The whole Spark dialect, without the engine's rules."""
        return self.spark.sql(text)


def version_info() -> dict[str, str]:
    import sys

    import pyspark

    return {"engine": "0.1.0", "spark": pyspark.__version__, "python": sys.version.split()[0]}
