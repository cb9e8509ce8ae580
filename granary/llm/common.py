"""What several operators share: scratch tables, Arrow batches, hashing of words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows a batch that goes to Python holds; with long texts this bounds a worker's memory.
BATCH_ROWS = 1000
#: Entries that a worker's word cache holds before it starts afresh.
CACHE_ENTRIES = 200_000


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with batches to Python of BATCH_ROWS rows unless the user chose a number."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local session gets a local folder, and any other an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/granary-{spark.sparkContext.applicationId}"
    path = f"{base.rstrip('/')}/granary/{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


#: The folders that scratch_dir gave out within temporary().
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes the scratch folders made inside at its end, when what was read from them is written elsewhere.

    The frames of stored() that are put into the list stay; an enclosing temporary() deletes them.
    """
    outer, made, lasting = _made.get(), [], []
    before = _made.set(made)
    try:
        yield lasting
    finally:
        stay = {frame.scratch for frame in lasting}
        for path in made:
            if path not in stay:
                deleted(spark, path)
        _made.reset(before)
        if outer is not None:
            outer.extend(stay)


#: Spark's setting that frees the shuffle files of a finished query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes the rows to the shared folder and reads them back, which cuts the lineage for every executor.

    The shuffle files of the write are freed at its end. The second result is the folder.
    """
    spark = session(df)
    path, before = scratch_dir(spark), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """stored_at, with the folder as the frame's attribute scratch."""
    out, path = stored_at(df)
    out.scratch = path
    return out


def discarded(*frames: DataFrame) -> None:
    """Deletes the tables of frames that stored() gave and nothing reads any more."""
    for frame in frames:
        deleted(frame.sparkSession, frame.scratch)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder that stored_at wrote, in whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bits of a sieve at most, as a power of two, and for each key; bits of a block, which bitmap_construct_agg fixes.
SIEVE_BITS, KEY_BITS, BLOCK_BITS = 26, 6, 15


def sieve(keys: DataFrame) -> Callable[..., DataFrame]:
    """picked(rows, *columns): the rows whose columns are a row of keys, all of bigint, and a few others.

    With held=False it gives the rest, of which none is in keys. A table of one bit for each hash, of 2^KEY_BITS bits
    a key and 8 MB at most, is made on the executors and broadcast, and rows stay where they are. Beyond some million
    keys it lets more others pass, so what follows must be exact by itself.
    """
    bits = min(SIEVE_BITS, max(BLOCK_BITS, keys.count().bit_length() + KEY_BITS))

    def place(*columns: Column | str) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*columns), 64 - bits)

    places = keys.select(place(*keys.columns).alias("p"))
    made = places.groupBy(F.shiftright("p", BLOCK_BITS).alias("block")).agg(F.bitmap_construct_agg(F.col("p") % (1 << BLOCK_BITS)).alias("map"))
    blocks = stored(made)

    def picked(rows: DataFrame, *columns: Column, held: bool = True) -> DataFrame:
        name, p = "_" + uuid.uuid4().hex, place(*columns)
        named = blocks.select(F.col("block").alias(f"{name}_block"), F.col("map").alias(f"{name}_map"))
        joined = rows.join(F.broadcast(named), F.shiftright(p, BLOCK_BITS) == F.col(f"{name}_block"), "left")
        byte = F.substring(f"{name}_map", (F.shiftright(p % (1 << BLOCK_BITS), 3) + 1).cast("int"), F.lit(1))
        passes = F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), (p % 8).cast("int")), F.lit(0)) == 1
        return joined.filter(passes if held else ~passes).select(*[f"`{c}`" for c in rows.columns])

    return picked


def without(rows: DataFrame, keys: DataFrame, *columns: Column) -> DataFrame:
    """The rows whose columns, of bigint, are no row of keys. Only those that a sieve of the keys holds are shuffled."""
    picked = sieve(keys)
    same = reduce(Column.__and__, [c == F.col(k) for c, k in zip(columns, keys.columns, strict=True)])
    return picked(rows, *columns, held=False).unionAll(picked(rows, *columns).join(keys, same, "left_anti"))


def fields(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def as_bytes(column: str | Column) -> Column:
    """A text column as its UTF-8 bytes; null becomes empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("binary"), F.lit(bytearray()))


def struct_array(rows: list[tuple], schema: pa.Schema) -> pa.Array:
    """Rows as one Arrow struct array."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.StructArray.from_arrays(arrays, fields=list(schema))


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields(ddl))


def row_function(one: Callable[..., tuple], ddl: str, setup: Callable[[], Any] | None = None) -> Callable[..., Column]:
    """A column function: one(row values) gives a tuple with the fields of ddl.

    The values travel in Arrow batches and the other columns of a row stay in
    the JVM. setup, if given, runs once for a batch and its result is passed first.
    """

    schema = arrow_schema(ddl)

    def batch(*arrays: pa.Array) -> pa.Array:
        first = (setup(),) if setup else ()
        return struct_array([one(*first, *values) for values in zip(*(a.to_pylist() for a in arrays), strict=True)], schema)

    return F.arrow_udf(batch, fields(ddl))


def added(df: DataFrame, result: Column, ddl: str) -> DataFrame:
    """df with the fields of a struct column; a column of df with the name of a new one is replaced."""
    new = fields(ddl).names
    holder = "_" + uuid.uuid4().hex
    kept = [f"`{c}`" for c in df.columns if c.lower() not in {n.lower() for n in new}]
    with_struct = df.withColumn(holder, result)
    return with_struct.select(*kept, *[F.col(holder)[n].alias(n) for n in new])


def mapped(df: DataFrame, function: Callable[[Iterator[list[tuple]]], Iterator[list[tuple]]], ddl: str) -> DataFrame:
    """mapInArrow over plain rows: function turns an iterator of row lists into another."""

    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (list(zip(*(c.to_pylist() for c in b.columns), strict=True)) for b in batches)
        for out in function(rows):
            yield pa.RecordBatch.from_struct_array(struct_array(out, schema))

    return df.mapInArrow(run, fields(ddl))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to CACHE_ENTRIES words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


#: Fixed odd multipliers of the 64-bit mixers.
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray, k: int = 3) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(ODD[k])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(ODD[4])
    return x ^ (x >> np.uint64(32))


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """The distinct hashes, sorted, of each run of size words; fewer words make one shingle, none make none."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    n = min(size, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out + h[k : len(h) - n + 1 + k] + np.uint64(ODD[k % 3]), 3)
    return np.unique(out + np.uint64(n))


#: Tasks that a sample is dealt to.
SAMPLE_TASKS = 8


def sampled(df: DataFrame, total: int, wanted: int, seed: str, *names: str) -> DataFrame:
    """About wanted of the total rows, twice as many at most, in SAMPLE_TASKS partitions.

    A row is chosen by a seeded hash of the named columns, nulls included. Equal rows are chosen together,
    so the number is limited too.
    """
    rows = df
    if wanted < total:
        text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in names]
        at = F.conv(F.substring(F.md5(F.concat_ws("\1", F.lit(seed), *text)), 1, 8), 16, 10).cast("bigint")
        rows = df.filter(at < int(wanted / total * 2**32))
    return rows.limit(2 * wanted).repartition(SAMPLE_TASKS)


def lower_ascii(text: bytes) -> bytes:
    """bytes.lower() changes A-Z only."""
    return text.lower()
