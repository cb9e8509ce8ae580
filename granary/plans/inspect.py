"""Reads what Catalyst made of a plan, for assertions in tests and for tuning."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def optimized(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df: DataFrame) -> str:
    """The plan as it would run, with nothing left out of its scans."""
    key, spark = "spark.sql.maxMetadataStringLength", df.sparkSession
    before = spark.conf.get(key)
    spark.conf.set(key, "1000000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", physical(df))


def read_columns(df: DataFrame) -> list[list[str]]:
    """The columns that each file scan reads."""
    return [re.findall(r"(\w+):", x) for x in re.findall(r"ReadSchema: struct<([^>]*)>", physical(df))]


def exchanges(df: DataFrame) -> int:
    return len(re.findall(r"\bExchange\b", physical(df)))
