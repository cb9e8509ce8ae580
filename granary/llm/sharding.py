"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Within each source, rows are ranked in a seeded shuffle; a row's fractional
rank is (rank + 1/2) over the source's rows. All rows in the order of the
fractional rank are cut into equal runs, so that every shard has of each source
what the whole has, to within a row or so. The law is `rows`: shard counts are
at most one apart.

No rank is made in one task. A row's shuffle key is an MD5 of the seed and its
key, uniform by design; ranks come from a row number within a narrow range of
keys of one source, plus the number of rows in the ranges before, which a small
aggregate gives. A source with a third of all rows is spread over as many
ranges as any other share of rows is. The global order is made the same way
from ranges of the fractional rank. Rows that agree in source, key and text
are alike, so their order among themselves does not matter.

Only what the ranks need is sorted. placed() joins the shards to whole rows
afterwards, by the file and row that Spark's hidden _metadata column gives, so
long texts move once. That holds for a frame that is a plain scan of files;
rows of any other, where one place may stand for several rows, are carried
along instead.

A null source is a source of its own; a null key and a null text are allowed
(size 16, CRC 0). Repeated rows each get a slot. With no rows the result is
empty. Columns of docs pass through if asked for; one with the name of a result
is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS, SEED = 40, "granary-interleave"
OVERHEAD = 16
#: Rows that a range holds on average; ranges bound a task's work, whatever the input.
RANGE_ROWS = 4_000
#: Ranges at most, so that the table of their row counts stays small.
MAX_RANGES = 65_536
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shuffle_key(key: str, seed: str = SEED) -> Column:
    """32 hexadecimal digits, fixed by the seed and the row's key."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))


def _offsets(rows: DataFrame, groups: list[str], at: str) -> DataFrame:
    """For each range of a group, the group's rows in earlier ranges, and all its rows."""
    counts = rows.groupBy(*groups, at).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = whole.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *[F.col(c).alias(f"{c}_o") for c in (*groups, at)],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_all"),
    )


def _ranked(rows: DataFrame, groups: list[str], at: str, order: list[str]) -> DataFrame:
    """Adds _rank, from 0 within each group in the order of (at, order), and _all, the group's rows."""
    cells = [*groups, at]
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*cells).orderBy(*order)) - 1)
    offsets = _offsets(rows.select(*cells), groups, at)
    joined = numbered.join(offsets, [F.col(c) == F.col(f"{c}_o") for c in cells])
    return joined.withColumn("_rank", F.col("_at") + F.col("_before")).drop("_at", "_before", *[f"{c}_o" for c in cells])


def interleave(
    docs: DataFrame, shards: int = SHARDS, seed: str = SEED, key: str = "doc_id", text: str = "text",
    source: str = "source", keep: tuple[str, ...] = ("doc_id",), range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One row per row of docs: the columns in keep, then those of RESULT.

    slot counts from 0 without gaps within a shard. docs is counted once when this is called.
    """
    total = docs.count()
    ranges = min(MAX_RANGES, max(1, -(-total // range_rows)))
    kept = [c for c in keep if c.lower() not in RESULT]
    digits = F.conv(F.substring("_shuffle", 1, 8), 16, 10).cast("bigint")
    rows = (
        docs.select(
            *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)],
            F.col(source).isNull().alias("_none"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
            shuffle_key(key, seed).alias("_shuffle"),
            F.col(key).cast("string").alias("_key"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        )
        .withColumn("_range", F.shiftright(digits * ranges, 32))
    )
    ties = ["_shuffle", "_key", "text_crc32", "size"]
    within = _ranked(rows, ["_none", "_source"], "_range", ties)
    placed = within.withColumn("_part", (F.col("_rank") + 0.5) / F.col("_all")).drop("_rank", "_all")
    cut = placed.withColumn("_range", F.floor(F.col("_part") * ranges))
    ordered = _ranked(cut, [], "_range", ["_part", "_none", "_source", *ties])
    shard = F.expr(f"_rank * {shards} div _all")
    start = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    return ordered.withColumn("shard", shard).select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)],
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("_rank") - start).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _is_scan(docs: DataFrame) -> bool:
    """Whether a frame is files read as Parquet and nothing else."""
    plan = docs._jdf.queryExecution().analyzed()
    return plan.nodeName() == "LogicalRelation" and plan.simpleString(100).rstrip().endswith("parquet")


def placed(docs: DataFrame, **options) -> DataFrame:
    """The whole rows of docs with the columns of RESULT. options are those of interleave."""
    own = [c for c in docs.columns if c.lower() not in RESULT]
    if not _is_scan(docs):
        return interleave(docs, keep=tuple(own), **options)
    found = docs.select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    shards = interleave(found, keep=("_file", "_row"), **options)
    named = shards.select(F.col("_file").alias("_file_s"), F.col("_row").alias("_row_s"), *RESULT)
    rows = found.select(*[f"`{c}`" for c in own], "_file", "_row")
    joined = rows.join(named, (F.col("_file") == F.col("_file_s")) & (F.col("_row") == F.col("_row_s")))
    return joined.select(*[f"`{c}`" for c in own], *RESULT)
