"""Each stage on odd rows and clashing columns, and the whole run."""

import os
import random
from collections import Counter

import pytest
from llm_data import ODD, documents
from pyspark.sql import functions as F

import corpus_pipeline as p
from granary.llm import common

CLASHES = ("kept", "n_tokens", "rate", "copies", "posterior", "spans", "size", "shard", "digest", "label", "at", "id", "_drop_x")


def odd(spark, tmp_path, name):
    rows = documents(spark, [*ODD, *ODD[3:6]])
    for c in CLASHES:
        rows = rows.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(-1))))
    rows.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


@pytest.mark.parametrize("stage", [f for _, f in p.STAGES], ids=[n for n, _ in p.STAGES])
def test_stage_takes_odd_rows(spark, sf, tmp_path, stage):
    docs = odd(spark, tmp_path, "odd")
    got = stage(spark, docs, sf)
    last = stage is p.shards
    results = [c for c in p.sharding.RESULT] if last else []
    assert got.columns == [c for c in docs.columns if c not in results] + results
    rows = got.collect()
    for r in rows:
        for c in CLASHES:
            assert c in results or r[c] == f"{c}{-1 if r.doc_id is None else r.doc_id}"
    count = Counter((r.doc_id, r.text) for r in docs.collect())
    kept = Counter((r.doc_id, r.text) for r in rows)
    if stage is p.quality:
        assert {k for k, _ in kept} == {5, None}
    elif stage is p.near_duplicates:
        assert {k: 1 if k[0] is not None else n for k, n in count.items()} == kept
    elif stage is not p.mixture:
        assert kept == count
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_placed_equals_interleave(spark, sf, tmp_path):
    docs = odd(spark, tmp_path, "placed")
    docs.drop("size", "shard").write.parquet(str(tmp_path / "plain"))
    docs = spark.read.parquet(str(tmp_path / "plain"))
    assert p.sharding._is_scan(docs) and not p.sharding._is_scan(docs.filter("doc_id > 0"))
    many = docs.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2))))
    assert p.sharding.placed(many, shards=3).count() == 2 * docs.count()
    a = p.sharding.placed(docs, shards=3)
    b = p.sharding.interleave(docs, 3, keep=tuple(docs.columns))
    assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert p.sharding.placed(documents(spark), shards=3).count() == len(ODD)


def test_run_leaves_one_table(spark, sf):
    base = f"{spark.conf.get('spark.checkpoint.dir')}/granary".removeprefix("file://")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    got = p.run(spark, sf).collect()
    assert len(set(os.listdir(base)) - before) == 1
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got and all(texts[r.doc_id] == r.text for r in got)
    assert sorted(r.slot for r in got if r.shard == 0) == list(range(sum(r.shard == 0 for r in got)))


def scratch(spark):
    base = f"{spark.conf.get('spark.checkpoint.dir')}/granary".removeprefix("file://")
    return {f"{base}/{x}" for x in os.listdir(base)} if os.path.isdir(base) else set()


def size(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(path) for f in names)


def long_texts(spark, tmp_path, rows=300):
    """Few words, all of them long and random, so that texts are nearly all there is to move."""
    rng = random.Random(4)
    texts = [" ".join(rng.randbytes(600).hex() for _ in range(30)) for _ in range(rows)]
    texts[-5:] = [texts[k] + " x" for k in range(5)]
    documents(spark, [(k, t, "en", "s", k) for k, t in enumerate([*texts, texts[0]])]).write.parquet(str(tmp_path / "long"))
    return spark.read.parquet(str(tmp_path / "long"))


@pytest.mark.parametrize("bits", [6, 26])
def test_without_is_an_anti_join(spark, monkeypatch, bits):
    """Also where the sieve is so small that most rows pass it."""
    monkeypatch.setattr(common, "SIEVE_BITS", bits)
    ids = [(k, k % 7) for k in range(400)] + [(None, 1), (3, None), (3, 3)]
    rows = spark.createDataFrame(ids, "id bigint, at bigint")
    keys = spark.createDataFrame([(k, k % 5) for k in range(0, 400, 3)] + [(None, 1)], "x bigint, y bigint")
    held = common.sieve(keys)(rows, "id", "at")
    want = Counter(r for r in ids if r[0] is None or r[1] is None or r[0] % 3 or r[0] % 5 != r[1])
    got = common.without(rows, keys, F.col("id"), F.col("at"))
    assert Counter(map(tuple, got.collect())) == want and got.columns == rows.columns
    assert {r for r in ids if r not in want} <= set(map(tuple, held.collect()))
    assert (held.count() > 250) == (bits == 6) and held.columns == rows.columns
    assert common.without(rows, keys.limit(0), F.col("id"), F.col("at")).count() == len(ids)


def test_near_duplicates_shuffles_no_text_that_is_nobodys_copy(spark, sf, tmp_path):
    docs = long_texts(spark, tmp_path)
    before, key = scratch(spark), "spark.sql.autoBroadcastJoinThreshold"
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    spark.conf.set(key, "-1")
    try:
        at = written()
        got = [r.doc_id for r in p.near_duplicates(spark, docs, sf).collect()]
        moved = written() - at
    finally:
        spark.conf.unset(key)
    assert sorted(got) == list(range(295))
    assert moved < size(tmp_path / "long") / 2
    assert sum(map(size, scratch(spark) - before)) < 20_000


def test_mixture_keeps_no_copy_of_the_texts(spark, sf, tmp_path):
    docs, before = long_texts(spark, tmp_path), scratch(spark)
    got = p.mixture(spark, docs, sf).collect()
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert got and {(r.doc_id, r.text) for r in got} <= texts
    assert not any("text" in spark.read.parquet(x).columns for x in scratch(spark) - before)
