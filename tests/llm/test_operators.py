"""Operators against brute force, on odd rows and on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_data import ODD, documents
from oracle import connect, same
from pyspark.sql import functions as F

from granary.llm import (
    chat_windows, common, decontamination, fertility, language_id, mixing, queries, sharding, token_counts, toxicity,
)
from granary.llm.components import components


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# op1


def base(text):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    wins = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(wins)
    hit = {k + o for k, w in enumerate(wins) if often[w] > 1 for o in range(5)}
    lines, seen, dup = data.split(b"\n"), set(), 0
    for x in lines:
        if re.search(rb"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    n = len(words)
    failed = n < 10 or 100 * len(hit) > 20 * n
    return n, sum(len(w.decode()) for w in words), len(re.findall("[#*$%&|<>]", text or "")), dup, len(hit), failed


def test_fertility_base_rules(spark, sf):
    docs = documents(spark).unionByName(spark.read.parquet(f"{sf}/documents.parquet"), True)
    got = fertility.measure(docs.withColumn("kept", F.lit("clash"))).collect()
    for r in got:
        want = base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)
    assert len(got) == docs.count()
    assert fertility.measure(docs.limit(0)).count() == 0


def test_fertility_bands_part_prose_from_noise():
    prose = ODD[4][1] * 1 + " It was a quiet day and nobody came to the house until the evening."
    noise = " ".join("".join(random.Random(k).choices("#$%xq9", k=9)) for k in range(60))
    assert fertility.judge(prose.encode(), "en", fertility.BANDS)[-1]
    assert not fertility.judge(noise.encode(), "en", fertility.BANDS)[-1]
    assert fertility.script("漢字漢字 a") == "other"


def test_measures_equal_a_plain_encoder(spark, sf):
    """Characters a token, share of part tokens and entropy, with merges done one by one."""
    import base64

    import regex

    ranks = {}
    for name in (fertility.ENGLISH, fertility.MANY):
        with open(public_tokenizers.path(name), "rb") as f:
            ranks[name] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    def encode(name, text):
        for piece in regex.findall(public_tokenizers.PATTERN, text):
            parts = [bytes([c]) for c in piece.encode()]
            while pairs := [(ranks[name][a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks[name]]:  # noqa: B905
                k = min(pairs)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            yield from parts

    def part(token):
        try:
            return not token.decode()
        except UnicodeDecodeError:
            return True

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op1_tokenizer_fertility(spark, sf).collect():
        t = docs[r.doc_id].text or ""
        if len(t) > 3000:
            continue
        band = fertility.BANDS[r.band]
        tokens = list(encode(band.vocabulary, t))
        n, seen = len(tokens), Counter(tokens)
        bits = -sum(c / n * np.log2(c / n) for c in seen.values()) / np.log2(min(n, 512)) if n > 1 else 0.0
        share = sum(map(part, tokens)) / max(n, 1)
        assert (r.n_tokens, r.chars_per_token, r.fallback_share) == (n, pytest.approx(len(t) / max(n, 1)), pytest.approx(share))
        assert r.entropy == pytest.approx(min(1.0, bits), abs=1e-9)
        slack = fertility.SLACK / max(n, 1) ** 0.5
        within = band.low_chars * (1 - slack) <= len(t) / max(n, 1) <= band.high_chars * (1 + slack)
        assert r.kept == (not base(t)[-1] and within and share <= band.max_fallback + slack / 4 and min(1.0, bits) >= band.low_entropy)
        assert r.band == (docs[r.doc_id].lang if docs[r.doc_id].lang in fertility.BANDS else r.band)


def test_repeated_words_with_many_words():
    rng = random.Random(2)
    words = [b"%d" % rng.randrange(9000) for _ in range(20_000)]
    words[100:110] = words[5000:5010]
    text = b" ".join(words)
    assert fertility.base_counts(text)[4] == base(text.decode())[4] > 0


# op2, op5, op9


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name])


@pytest.mark.parametrize("group_bytes", [8_000_000, 40])
def test_decontamination_edges(spark, group_bytes):
    words = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j0".split()
    items = [(10, " ".join(words)), (9, "Short Item"), (9, "short item"), (8, None), (7, ""), (None, "a1 b2"), (6, "ß é ü")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    texts = ["x " + " ".join(words[1:9]) + " y", "SHORT-item; short item", "ß,é,ü a1 b2", " ".join(words * 2), None, "", "é ü"]
    docs = documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]).withColumn("n_hit", F.lit(1))
    got = {r.doc_id: r for r in decontamination.decontaminate(docs, bench, group_bytes=group_bytes).collect()}
    want = [(10, 8, "10"), (4, 4, "9"), (5, 3, "6"), (20, 20, "10"), (0, 0, ""), (0, 0, ""), (2, 0, "")]
    for k, (n, hit, found) in enumerate(want):
        r = got[k]
        n_items = len(found.split(",")) if found else 0
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, n_items)
        assert r.items_sha256 == hashlib.sha256(found.encode()).hexdigest() and r.contaminated == (n_items > 1)
    empty = decontamination.decontaminate(docs, bench.limit(0)).collect()
    assert all(r.n_items == 0 and not r.contaminated for r in empty)
    assert decontamination.decontaminate(docs.limit(0), bench, group_bytes=group_bytes).count() == 0
    twice = decontamination.decontaminate(docs.union(docs), bench, group_bytes=group_bytes).collect()
    assert len(twice) == 2 * len(texts) and len({(r.doc_id, r.items_sha256, r.n_hit) for r in twice}) == len(texts)


def test_decontamination_equals_brute_force_in_ten_groups(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(40)}"
    items = [(f"i{k}", " ".join(word() for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 30])))) for k in range(60)]
    texts = []
    for _ in range(80):
        w = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w) + 1) : 0] = rng.choice(items)[1].split()
        texts.append(" ".join(w))
    texts.append(" ".join(word() for _ in range(40_000)) + " " + items[-1][1])
    bench = spark.createDataFrame(items, "item_id string, text string")
    total = sum(len(t) for _, t in items)
    assert len(list(decontamination.item_groups(bench, "item_id", "text", total // 12))) >= 10
    docs = documents(spark, [(k, t, None, None, None) for k, t in enumerate(texts)])
    for group_bytes in (10**6, total // 12):
        got = {r.doc_id: r for r in decontamination.decontaminate(docs, bench, group_bytes=group_bytes).collect()}
        for k, t in enumerate(texts):
            w = t.split()
            at = {}
            for i, x in items:
                v = x.split()
                n = min(8, len(v))
                for p in {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}:
                    at.setdefault((n, p), []).append(i)
            hit, found = set(), set()
            for n in {n for n, _ in at}:
                for j in range(len(w) - n + 1):
                    if (n, tuple(w[j : j + n])) in at:
                        hit |= set(range(j, j + n))
                        found |= set(at[n, tuple(w[j : j + n])])
            assert (got[k].n_words, got[k].n_hit, got[k].item_ids) == (len(w), len(hit), sorted(found))


def test_decontamination_tables_are_small():
    import tracemalloc

    rng = random.Random(1)
    items = [(str(k), " ".join(f"{rng.randrange(10**6):x}" for _ in range(1000)).encode()) for k in range(100)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    group = decontamination.Group(items)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(group.ids) == 100 and held < 20 * size + 2**24  # and the cache of word hashes


# op3


def test_rates_meet_targets(spark):
    rng = random.Random(4)
    data = []
    for k in range(600):
        a = [rng.random() ** 3 for _ in range(3)]
        data.append((k, rng.randrange(1, 400), [x / sum(a) for x in a]))
    scored = spark.createDataFrame(data, "doc_id bigint, n_tokens bigint, posterior array<double>")
    totals = mixing.domain_totals(scored, 3, [])
    targets = [totals[0], totals[1] * 0.8, totals[2] * 0.9]
    steps, reached = mixing.solve(scored, targets)
    assert reached == pytest.approx(targets, rel=1e-2)
    rates = [r[0] for r in scored.select(mixing.rate_column(steps, 3)).collect()]
    assert min(rates) >= 0
    p, t = np.array([d[2] for d in data]), np.array([d[1] for d in data])
    assert (p * (t * np.array(rates))[:, None]).sum(0) == pytest.approx(targets, rel=1e-2)


def test_missed_targets_are_reported(spark):
    scored = spark.createDataFrame([(1, 10, [0.5, 0.5])], "doc_id bigint, n_tokens bigint, posterior array<double>")
    with pytest.warns(UserWarning, match="rates miss a target by 5 of 10 tokens"):
        mixing.solve(scored, [10.0, 0.0])


def test_mixture_odd_rows(spark):
    docs = documents(spark)
    labels = documents(spark, [(i, "good fine text" if i % 2 else "bad rude text", None, None, None) for i in range(60)])
    labels = labels.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 1, "high").otherwise("toxic").alias("domain"))
    mixed, fitted = mixing.mix(docs, labels, {"high": 0.9, "toxic": 0.1}, "high")
    model = fitted.model
    assert model.domains == ["high", "toxic"] and len(fitted.targets) == len(fitted.reached) == 2
    got = mixed.collect()
    assert len(got) == len(ODD) and all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-9 for r in got)
    assert mixing.posterior(model, b"good fine text")[1][0] > 0.8
    assert mixing.emitted(mixed).count() == sum(r.copies for r in got)
    alone, fitted = mixing.mix(docs, labels.limit(0), {"high": 1.0}, "high")
    assert fitted.model.domains == ["all"] and {r.copies for r in alone.collect()} == {1}
    counted, fitted = mixing.mix(docs.withColumn("rate", F.lit("clash")), labels, {}, "", tokens="n_chars")
    assert sum(r.n_tokens for r in counted.collect()) == sum(r[4] or 0 for r in ODD) == pytest.approx(sum(fitted.targets))
    assert mixing.mix(docs.limit(0), labels, {"high": 1.0}, "high")[0].count() == 0


# op4


def test_token_counts_equal_the_library(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    docs = documents(spark).unionByName(spark.read.parquet(f"{sf}/documents.parquet"))
    got = token_counts.count_tokens(docs.withColumn("n_bytes", F.lit("clash"))).collect()
    for r in got:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 512)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


# op5


@pytest.mark.parametrize("n", [0, 1, 39, 1000])
def test_shards(spark, n):
    sources = ["hot"] * 5 + ["a", "b", None]
    data = [(k // 2 if k < 20 else k, f"text {k % 7}" if k % 11 else None, None, sources[k % 8], k) for k in range(n)]
    docs = documents(spark, data).withColumnRenamed("n_chars", "slot")
    got = sharding.interleave(docs, range_rows=50).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == n
    if n:
        sizes = [counts.get(k, 0) for k in range(40)]
        assert max(sizes) - min(sizes) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    by_id = {d[0]: d for d in data}
    for r in got:
        if by_id[r.doc_id][0] >= 20:
            t = (by_id[r.doc_id][1] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "rows", None)


def test_every_shard_has_the_mixture(spark):
    data = [(k, "t", None, "hot" if k % 3 == 0 else f"s{k % 5}", 0) for k in range(4000)]
    docs = documents(spark, data)
    placed = sharding.interleave(docs, keep=("doc_id", "source"), range_rows=100).collect()
    whole, cells = Counter(r.source for r in placed), Counter((r.shard, r.source) for r in placed)
    assert all(abs(cells[s, name] - c / 40) <= 2 for s in range(40) for name, c in whole.items())
    reference = sorted(
        ((rank + 0.5) / len(group), name, k)
        for name in whole
        for group in [sorted((hashlib.md5(f"{sharding.SEED}:{d[0]}".encode()).hexdigest(), d[0]) for d in data if d[3] == name)]
        for rank, (_, k) in enumerate(group)
    )
    got = [r.doc_id for r in sorted(placed, key=lambda r: (r.shard, r.slot))]
    assert [p for p, _, _ in reference] == sorted(p for p, _, _ in reference)
    place = {k: p for p, _, k in reference}
    assert [place[k] for k in got] == sorted(place.values())


# op6


def test_chat_windows_round_trip(spark):
    rng = random.Random(8)
    control = ["</turn>", "<turn user>\n", "\\", "\\<", "plain words here", "\n", "é😀"]
    data = []
    for conv in [None, *range(1, 30)]:
        for turn in range(rng.randrange(1, 40)):
            role = "system" if not turn and (conv or 0) % 2 else rng.choice(["user", "assistant", None, "a>b\n"])
            said = None if rng.random() < 0.05 else "".join(rng.choices(control, k=rng.randrange(60)))
            data.append((conv, turn, role, said, "extra"))
    data.append((31, 0, "assistant", "long " * 3000, "extra"))
    turns = spark.createDataFrame(rng.sample(data, len(data)), "conv_id bigint, turn bigint, role string, text string, window string")
    windows = chat_windows.format_windows(turns)
    seen = windows.collect()
    assert all(r.over_budget == (r.n_tokens > chat_windows.BUDGET) for r in seen)
    assert any(r.n_context for r in seen) and any(r.over_budget for r in seen)
    got = {r.conv_id: r for r in chat_windows.digest_windows(windows).collect()}
    for conv in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == conv), key=lambda d: d[1])
        said = "".join(d[3] or "" for d in own if d[2] == "assistant")
        every = "".join(f"{d[2] or ''}\n{d[3] or ''}\n" for d in own)
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(own), len(said))
        assert r.turns_sha256 == hashlib.sha256(every.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.formatted_chars == sum(len(w.text) for w in seen if w.conv_id == conv)
    assert chat_windows.format_windows(turns.limit(0)).count() == 0


# op8


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = queries.op8_compression_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.93 * len(found)
    dictionaries = language_id.learn(docs)
    got = {r.doc_id: r for r in language_id.identify(documents(spark).withColumn("score", F.lit("clash")), dictionaries).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1, 2, 3))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.learn(documents(spark, ODD[:1])) == {}
    assert {r.lang_pred for r in language_id.identify(documents(spark), {}).collect()} == {"und"}


def test_language_equals_brute_force(spark, sf):
    """Dictionaries of whole texts in the order of a hash, and the smallest of the compressed sizes."""
    import zstandard

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    said = lambda t: " ".join(re.findall(r"[^\W\d_]+", (t or "").lower())).encode()
    held = lambda r: zlib.crc32(str(r.doc_id).encode()) % 4 == 2
    seen = Counter(r.lang for r in docs if not held(r) and r.lang and r.text is not None)
    models = {}
    for lang in sorted(seen, key=lambda x: (-seen[x], x)):
        own = sorted((hashlib.md5(f"language:{r.doc_id}".encode()).hexdigest(), said(r.text)) for r in docs if not held(r) and r.lang == lang and r.text is not None)
        room, kept = language_id.DICTIONARY_BYTES, []
        for _, t in own:
            if t and len(t) <= room:
                kept.append(t)
                room -= len(t) + 1
        held_by = zstandard.ZstdCompressionDict(b"\n".join(kept), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        models[lang] = zstandard.ZstdCompressor(dict_data=held_by, level=language_id.LEVEL, write_content_size=False)
    got = {r.doc_id: r for r in queries.op8_compression_language(spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        assert got[r.doc_id].held_out == held(r)
        t = said(r.text)
        sizes = {lang: len(m.compress(t)) for lang, m in models.items()} if t else {}
        best = [lang for lang in models if sizes and sizes[lang] == min(sizes.values())] or ["und"]
        assert got[r.doc_id].lang_pred == best[0]


def test_many_labels(spark):
    rng = random.Random(5)
    words = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(20)] for _ in range(500)]
    data = [(k, " ".join(rng.choices(words[k % 500], k=30) + rng.choices(words[k % 70], k=5)), f"l{k % 500}", f"d{k % 70}", k) for k in range(2000)]
    docs = documents(spark, data)
    dictionaries = language_id.learn(docs)
    assert len(dictionaries) == 500 and all(len(d) <= language_id.ALL_BYTES // 500 for d in dictionaries.values())
    found = language_id.identify(docs.filter("doc_id < 40"), dictionaries).collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 30
    mixed, fitted = mixing.mix(docs, docs.withColumn("domain", F.col("source")), {"d1": 1.0}, "d1", keep=["doc_id"])
    assert len(fitted.model.domains) == 70 and fitted.reached == pytest.approx(fitted.targets, rel=1e-2)
    assert mixed.count() == 2000


# op10


def test_toxicity(spark):
    rng = random.Random(3)
    data = [(k, " ".join(rng.choices("some calm words about the sea and sky".split(), k=30)) + (" you vile scumbag" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(400)]
    labelled = spark.createDataFrame(data, "doc_id bigint, text string, toxic int")
    model = toxicity.learn(labelled)
    assert toxicity.score(model, b"the sea, vile scumbag")[1] == 1 and toxicity.score(model, b"the calm sea")[1] == 0
    got = toxicity.rate(documents(spark).withColumn("predicted", F.lit("clash")), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    nothing = toxicity.learn(labelled.filter("toxic = 0"))
    assert {r.score for r in toxicity.rate(documents(spark), nothing).collect()} == {0.0}


def test_toxicity_equals_brute_force(spark, sf, monkeypatch):
    """The registered query against dense naive Bayes features and the same descent; the table is small, so rarer features count."""
    monkeypatch.setattr(toxicity, "MIN_ROWS", 3)
    monkeypatch.setattr(toxicity, "MIN_RATIO", 0.7)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1

    def grams(text):
        t = " " + re.sub(r"[^a-z\x80-\U0010ffff]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + " "
        data, out = t.encode(), set()
        for n in toxicity.SIZES:
            for k in range(len(data) - n + 1):
                code = 0
                for c in data[k : k + n]:
                    code = (code * 257 + c + 1) % 2**64
                out.add((code * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BITS))
        return out

    seen = {k: grams(t) for k, t in docs.items()}
    train = [(seen[k], int(y > 0)) for k, y in labels.items() if k in docs and docs[k] is not None and y is not None and not held(k)]
    toxic, other = (Counter(g for f, y in train if y == want for g in f) for want in (1, 0))
    n = [sum(y == want for _, y in train) for want in (1, 0)]
    ratio = {g: np.log((toxic[g] + 1) / (n[0] + 2) / ((other[g] + 1) / (n[1] + 2))) for g in {*toxic, *other} if toxic[g] + other[g] >= toxicity.MIN_ROWS}
    at = {g: i for i, g in enumerate(sorted(g for g in ratio if abs(ratio[g]) >= toxicity.MIN_RATIO))}
    x, y = np.zeros((len(train), len(at))), np.array([float(v) for _, v in train])
    for i, (f, _) in enumerate(train):
        for g in f & at.keys():
            x[i, at[g]] = ratio[g]
    w, b, gw, gb = np.zeros(len(at)), np.log(y.mean() / (1 - y.mean())), 1e-8, 1e-8
    for _ in range(toxicity.ROUNDS):
        e = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        grad = x.T @ e / len(y) + toxicity.PENALTY * w
        gw, gb = gw + grad**2, gb + e.mean() ** 2
        w, b = w - toxicity.RATE * grad / np.sqrt(gw), b - toxicity.RATE * e.mean() / np.sqrt(gb)
    got = queries.op10_toxicity(spark, sf).collect()
    assert len(got) == len(docs) and len(at) > 100
    for r in got:
        z = b + sum(w[at[g]] * ratio[g] for g in seen[r.doc_id] & at.keys())
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
        assert r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.7)


def test_learners_take_null_and_repeated_keys(spark):
    data = [(None if k % 3 == 0 else k % 5, f"{'vile scum' if k % 2 else 'calm sea'} word{k % 7}", k % 2, "ab"[k % 2]) for k in range(60)]
    rows = spark.createDataFrame(data, "doc_id bigint, text string, toxic int, domain string")
    for wanted in (20, 4000):
        model = toxicity.learn(rows, rows=wanted)
        assert wanted < 60 or toxicity.score(model, b"vile scum")[0] > toxicity.score(model, b"calm sea")[0]
        assert mixing.learn(rows, rows=wanted).domains in (["a", "b"], ["a"], ["b"], ["all"])
    same_rows = spark.createDataFrame(data[:1] * 500, rows.schema)
    assert common.sampled(same_rows, 500, 10, "x", "doc_id", "text").count() in (0, 20)


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101)]
    got = {r.id: r.label for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 103: 100}
