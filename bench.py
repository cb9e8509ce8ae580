"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and then RUNS times into a sink that drops the
rows; its figure is the median. BENCH_SF_DIR and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession

from granary import queries

RUNS = 5
HEADLINES = (
    "tpch_q1", "tpch_q6", "sql_q6", "agg_group_single", "agg_over_expr", "agg_group_multi",
    "join_inner", "join_filter_pushdown", "sort_asc", "topn_desc", "filter_range",
)


def timed(df: DataFrame) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, seconds = queries.queries(), {}
    for name in HEADLINES:
        timed(known[name](spark, sf_dir))
        seconds[name] = round(statistics.median(timed(known[name](spark, sf_dir)) for _ in range(RUNS)), 4)
    total = round(sum(seconds.values()), 4)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
