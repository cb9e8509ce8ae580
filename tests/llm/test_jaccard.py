import random

import numpy as np
import pytest
from llm_data import documents
from pyspark.sql import functions as F

from granary.llm import jaccard_join


def brute(rows, size, num, den):
    sets = []
    for doc, text, *_ in rows:
        w = (text or "").encode().lower().split()
        n = min(size, len(w))
        sets.append((doc, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()))
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((d, len(s), root(d)) for d, s in sets)


def corpus(seed=5):
    """Families of copies with more and more edits, a shared passage, short texts, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(4000))
    passage = [word() for _ in range(40)]
    texts = []
    for family in range(6):
        base = [word() for _ in range(rng.choice([12, 30, 90, 200]))]
        for k in range(25):
            t = list(base)
            for _ in range(k % 7 if family else k % 3):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    texts += [" ".join([*(word() for _ in range(rng.randrange(30, 90))), *passage]) for _ in range(80)]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    texts += [texts[0]] * 30 + ["A b", "a B", "", "  \n", None, "x", "é é é é", "É é é é"]
    return [(i, t, "en", "s", 0) for i, t in enumerate(rng.sample(texts, len(texts)))]


@pytest.mark.parametrize(("size", "threshold", "hot"), [(3, (90, 100), 64), (5, (80, 100), 64), (3, (80, 100), 6), (2, (60, 100), 6)])
def test_components_equal_brute_force(spark, monkeypatch, size, threshold, hot):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    rows = corpus()
    got = jaccard_join.jaccard_components(documents(spark, rows), size, threshold, parts=size - 1).collect()
    assert sorted(map(tuple, got)) == brute(rows, size, *threshold)


def pooled(band, m, wanted):
    """Words by the segment that their shingle of one word falls in."""
    pools = [[] for _ in range(m)]
    for k in range(wanted):
        pools[int(jaccard_join._segments(jaccard_join._set_of(b"w%d" % k, 1), band, m)[0])].append(f"w{k}")
    return lambda at, n: [pools[at].pop() for _ in range(n)]


def test_hot_and_empty_segments_together(spark, monkeypatch):
    """Pairs whose shared segments are empty, hot or one deletion apart, in layouts with and without deletions."""
    monkeypatch.setattr(jaccard_join, "HOT", 6)
    threshold, band = (80, 100), jaccard_join.bands_of(15, (80, 100))[0]
    for plan in ((3, 3, 2), (6, 0, 2)):
        monkeypatch.setattr(jaccard_join, "layout", lambda b, sets, t, plan=plan: plan if b == band else (1, 1, 0))
        m = plan[0]
        take = pooled(band, m, 4000)
        common, texts = take(1, 6), []
        for _ in range(5):
            a = take(0, 1) + common + take(2, 5)
            texts += [a, a + take(0, 1) + take(2, 2)]
        texts += [take(0, 4) + common + take(2, 4) for _ in range(30)]
        texts += [common + take(2, 8) for _ in range(8)]
        rows = [(k, " ".join(t), "en", "s", 0) for k, t in enumerate(texts)]
        got = sorted(map(tuple, jaccard_join.jaccard_components(documents(spark, rows), 1, threshold).collect()))
        assert got == brute(rows, 1, *threshold)
        assert [c for _, _, c in got[:10]] == [0, 0, 2, 2, 4, 4, 6, 6, 8, 8]


def test_a_pair_of_a_wide_layout_is_found(spark, monkeypatch):
    """181 and 163 shingles, 163 of them common, in nine one-deletion segments of fifteen; decoys make four hot.

    The common shingles leave the unbroken segments with one shingle in the smaller set and two in the larger.
    """
    threshold = (90, 100)
    band = jaccard_join.bands_of(181, threshold)[0]
    plan = (15, 9, 4)
    monkeypatch.setattr(jaccard_join, "layout", lambda b, sets, t: plan if b == band else (1, 1, 0))
    take = pooled(band, 15, 6000)
    single = [take(k, 1) for k in range(4)]
    b = sum(single, []) + sum((take(k, 20) for k in range(4, 9)), []) + sum((take(k, 9) for k in range(9, 15)), []) + take(4, 5)
    a = b + sum((take(k, 1) for k in range(4)), []) + sum((take(k, 2) for k in range(4, 9)), []) + take(9, 4)
    assert (len(a), len(b)) == (181, 163)
    decoys = [[w for s in single for w in s] + [f"d{k}x{n}" for n in range(150)] for k in range(70)]
    rows = [(k, " ".join(t), "en", "s", 0) for k, t in enumerate([a, b, *decoys])]
    got = sorted(map(tuple, jaccard_join.jaccard_components(documents(spark, rows), 1, threshold).collect()))
    assert got == brute(rows, 1, *threshold) and got[1][2] == 0


def test_two_passes_keep_a_shared_signature():
    """Linked sets in random layouts, with random hot contents: they share a kept signature, or are both heavy and do in the second pass."""
    rng = np.random.default_rng(7)
    for trial in range(1500):
        n, m = int(rng.integers(3, 40)), int(rng.integers(1, 12))
        d = int(rng.integers(0, m + 1))
        spare = int(rng.integers(0, min(5, m + d)))
        differ = m + d - 1 - spare
        last = [int(x) for x in rng.integers(0, 3, 2)]
        differ = max(0, differ - max(last))
        base = rng.integers(0, 2**62, n + differ).astype(np.uint64)
        cut = int(rng.integers(0, differ + 1))
        a, b = np.unique(base[cut:]), np.unique(base[: len(base) - (differ - cut)])
        made = []
        for s, left in zip((a, b), last, strict=True):
            rows = [r for x in jaccard_join.signatures(s, 3, m, d, spare, left) for r in zip(*map(list, x), strict=True)]
            made.append((any(i < 0 for _, i, _ in rows), {h: (c, i) for c, i, h in rows if i >= 0}))
        hot = {h for _, rows in made for h in rows if rng.random() < (0.1, 0.4)[trial % 2]}
        heavy = []
        for weak, rows in made:
            cells = {c: (i % 4, i // 4) for h, (c, i) in rows.items() if h in hot}
            heavy.append(weak or sum(w for w, _ in cells.values()) > min((r for _, r in cells.values()), default=spare))
        kept = [set(rows) - hot for _, rows in made]
        if m + d - 1 - spare >= max(last) and not (heavy[0] and heavy[1]):
            assert kept[0] & kept[1]
        m2, spare2 = differ + max(last) + 1 + spare, spare
        second = [
            dict(zip(x[2].tolist(), x[1].tolist(), strict=True))
            for s, left in zip((a, b), last, strict=True) for x in jaccard_join.second_signatures(s, 3, m2, spare2, left)
        ]
        both = set(second[0]) & set(second[1])
        count = {h: 2 + int(rng.integers(0, 50)) for h in both}
        others = {h: 2 + int(rng.integers(0, 50)) for s in second for h in s if h not in both and rng.random() < 0.5}
        ranked = [sorted((h for h in s if h in count or h in others), key=lambda h: (-{**count, **others}[h], h))[spare2:] for s in second]
        assert set(ranked[0]) & set(ranked[1])


def test_every_layout_carries_its_weight():
    for threshold in ((90, 100), (80, 100), (60, 100)):
        for band in range(40):
            for sets in (1, 10**4, 10**7):
                m, d, spare = jaccard_join.layout(band, sets, threshold)
                differ = jaccard_join.band_sizes(band, threshold)[2]
                assert not differ and not m or m + d == differ + 1 + spare and d <= m
                more, left = jaccard_join.second_layout(band, threshold)
                assert more == differ + 1 + left


def test_slices_are_the_whole():
    rng = np.random.default_rng(3)
    for n in (1, 7, 60, 300):
        set_ = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
        for plan in ((20, 0, 4), (20, 12, 9), (20, 20, 1)):
            rows = lambda *p: sorted((*x,) for made in jaccard_join.signatures(set_, 5, *plan, 3, *p) for x in zip(*map(list, made), strict=True))  # noqa: E731, B023
            assert sorted(x for part in range(3) for x in rows(part, 3)) == rows()


def test_partners_share_a_band():
    for n in range(1, 400):
        for partner in range(n, n * 100 // 80 + 1):
            assert jaccard_join.bands_of(partner, (80, 100))[0] in jaccard_join.bands_of(n, (80, 100))


def test_blocks_of_one_bucket_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rows = corpus(9)
    got = jaccard_join.jaccard_components(documents(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, 90, 100)


def test_repeated_ids_nulls_and_nothing(spark):
    rows = [(1, "a b c d", "en", "s", 0)] * 3 + [(None, "a b c d", "en", "s", 0), (2, None, None, None, None), (3, "a b c d", "x", "y", 1)]
    docs = documents(spark, rows).withColumnRenamed("n_chars", "n_shingles")
    got = sorted(map(tuple, jaccard_join.jaccard_components(docs).collect()), key=str)
    assert got.count((1, 2, 1)) == 3 and (3, 2, 1) in got and (2, 0, 2) in got
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0
    kept = jaccard_join.representatives(docs, 3, (90, 100)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "None"]
    with pytest.raises(TypeError, match="doc_id must be a column of integers, not string"):
        jaccard_join.jaccard_components(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_texts_of_one_id_leave_one_by_one(spark):
    """Id 5 has a copy of 1, which goes, and a text of its own, near which 9 is."""
    own = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "a b c d", "", "", 0), (5, "a b c d", "", "", 0), (5, own, "", "", 0), (9, own + " x", "", "", 0), (5, own, "", "y", 0)]
    kept = jaccard_join.representatives(documents(spark, rows), 3, (90, 100)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "a b c d"), (5, own)]


@pytest.mark.parametrize("share", [0.1, 0.35])
def test_a_large_group_of_near_copies(spark, monkeypatch, share):
    """Many copies with edits, of which some link and most do not, all sharing hot signatures."""
    monkeypatch.setattr(jaccard_join, "HOT", 16)
    rng = random.Random(3)
    base = [f"b{k}" for k in range(60)]
    texts = []
    for k in range(300):
        t = list(base)
        for _ in range(int(k % 7 * share * 10)):
            t[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    got = jaccard_join.jaccard_components(documents(spark, rows), 3, (80, 100)).collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, 80, 100)
