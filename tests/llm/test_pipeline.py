from collections import Counter

import corpus_pipeline as p


def test_each_stage_acts_on_its_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [r.text.lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns = docs.columns
    kept = p.quality(spark, docs, sf)
    assert kept.columns == columns and 0.6 * docs.count() < kept.count() < docs.count()
    single = p.near_duplicates(spark, kept, sf)
    texts = [r.text for r in single.collect()]
    assert len(texts) == len(set(texts)) and single.columns == columns
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.lower().split() for t in texts)]
    assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a & b)
    clean = p.decontaminated(spark, single, sf)
    windows = {tuple(w[k : k + 8]) for w in bench for k in range(max(1, len(w) - 7))}
    for r in clean.collect():
        w = r.text.lower().split()
        assert not any(tuple(w[k : k + 8]) in windows for k in range(len(w)))
    mixed = p.mixture(spark, clean, sf)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    placed = p.shards(spark, mixed, sf)
    counts = Counter(r.shard for r in placed.collect())
    assert sum(counts.values()) == mixed.count() and max(counts.values()) - min(counts.values()) <= 1
