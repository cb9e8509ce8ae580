"""The corpus pipeline: five stages from raw documents to shards, each by one operator of granary.llm.

Every stage takes any rows of documents, none included. A null, empty or very
long text, a null language or source and a repeated row give what the stage's
operator says of them. Columns beside those that a stage reads pass through,
whatever their names; in the last stage one with the name of a result is
replaced. A document with a null id is nobody's copy; one with a null, empty or
short text fails the quality rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontamination, fertility, jaccard_join, mixing, sharding
from granary.llm.common import deleted, scratch_dir, temporary
from granary.llm.queries import ANCHOR, DOMAIN_WEIGHTS, quality_domain, table

#: Near duplicates: runs of five words, Jaccard similarity of at least 80 / 100.
NEAR_SIZE, NEAR_THRESHOLD = 5, (80, 100)
#: Slices of the signatures, of which one at a time is on disk.
NEAR_PARTS = 2


def _read(docs: DataFrame, *names: str) -> DataFrame:
    """docs with the columns that a stage reads, and the others in one struct, so that no name of theirs can clash."""
    return docs.select(*names, F.struct(*[f"`{c}`" for c in docs.columns if c not in names], F.lit(0).alias("_end")).alias("_others"))


def _whole(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """What a stage kept, with the columns of docs again."""
    back = [F.col(f"`{c}`") if c in rows.columns else F.col("_others")[c].alias(c) for c in docs.columns]
    return rows.select(*back)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules keep; null, empty and short texts go."""
    rows = _read(docs, "text", "lang")
    return _whole(fertility.measure(rows).filter("kept").select(*rows.columns), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies. Texts without words and null ids all stay."""
    return jaccard_join.representatives(docs, NEAR_SIZE, NEAR_THRESHOLD, parts=NEAR_PARTS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of eight words with an item of the benchmark; a text without words shares none."""
    rows = _read(docs, "text")
    found = decontamination.decontaminate(rows, table(spark, sf_dir, "benchmark"), min_items=1)
    return _whole(found.filter(~F.col("contaminated")).select(*rows.columns), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says; equal rows get equal numbers of copies."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled"), quality_domain().alias("domain"))
    texts = docs.select("doc_id", "text")
    labelled = texts.join(labels, F.col("doc_id") == F.col("labelled")).select("doc_id", "text", "domain")
    rows = _read(docs, "doc_id", "text")
    mixed, _ = mixing.mix(rows, labelled, DOMAIN_WEIGHTS, ANCHOR, keep=rows.columns)
    return _whole(mixing.emitted(mixed), docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot, every shard in the mixture of the whole."""
    return sharding.placed(docs)


#: The stages in order: each takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixture", mixture),
    ("shards", shards),
]

#: The tokenizer's cuts and the fitted rates are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again.

    What a stage has read goes when its result is written; the last result stays.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = scratch_dir(spark)
        with temporary(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if last:
            deleted(spark, last)
        docs, last = spark.read.schema(out.schema).parquet(path), path
    return docs
