"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import (
    chat_windows, decontamination, fertility, html_text, jaccard_join, language_id, mixing, sharding, token_counts,
    toxicity,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = fertility.measure(table(spark, sf_dir, "documents"))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "fallback_share", "entropy", "band",
    )


def op2_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: Token targets of the mixture, in proportion; the anchor keeps what it has.
DOMAIN_WEIGHTS, ANCHOR = {"high": 0.94, "low": 0.05, "toxic": 0.01}, "high"


def quality_domain() -> Column:
    """toxic, low or high, from the columns of labels; null where a label is missing."""
    toxic, quality = F.col("toxic"), F.col("quality")
    known = toxic.isNotNull() & quality.isNotNull()
    return F.when(known, F.when(toxic > 0, "toxic").when(quality > 0, "high").otherwise("low"))


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of labelled documents, each with its domain."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "text", quality_domain().alias("domain"))


def op3_soft_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed, fitted = mixing.mix(docs, domain_labels(spark, sf_dir), DOMAIN_WEIGHTS, ANCHOR, keep=["doc_id"])
    shares = [F.get("posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(fitted.model.domains)]
    return mixed.select("doc_id", "n_tokens", *shares, "rate", "copies")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"))


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat_windows.digest_windows(chat_windows.format_windows(turns.union(planted)))


def op7_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op8_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(4) == 2
    dictionaries = language_id.learn(docs.filter(~held_out))
    found = language_id.identify(docs, dictionaries)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(3) == 1
    known = docs.filter(~held_out).select("doc_id", "text").join(labels.filter(~held_out), "doc_id")
    rated = toxicity.rate(docs, toxicity.learn(known))
    return rated.select("doc_id", held_out.alias("held_out"), "score", "predicted")


#: Windows of eight words, or all words of a shorter item, joined by blanks.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, 
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(8, len(w)) AS n, array_to_string(w[k:k + least(8, len(w)) - 1], ' ') AS win
    FROM b, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS t(k) WHERE len(w) > 0),
x AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
    FROM d, (SELECT DISTINCT n FROM p) AS s, unnest(range(1, len(w) - n + 2)) AS t(k)),
h AS (SELECT x.doc_id, x.k, x.n, p.item FROM x JOIN p ON x.win = p.win AND x.n = p.n),
hw AS (SELECT doc_id, count(DISTINCT k + o) AS n_hit FROM h, unnest(range(0, n)) AS t(o) GROUP BY 1),
hi AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

#: The CRC of whole texts, byte by byte with a table made from the polynomial; ranks within sources, then over all rows.
OP5_SQL = r"""
WITH crcs AS (SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c
    FROM range(0, 256) AS r(b))),
x AS (SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
y AS (SELECT *, list_transform(range(0, len(h) // 2), lambda k: CAST('0x' || h[2 * k + 1:2 * k + 2] AS BIGINT)) AS bytes FROM x),
d AS (SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS source, md5('granary-interleave:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
    CAST(strlen(text) + 16 AS BIGINT) AS size,
    xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc FROM y, crcs),
r AS (SELECT *, (row_number() OVER (PARTITION BY none, source ORDER BY key, CAST(doc_id AS VARCHAR), crc, size) - 0.5::DOUBLE)
    / count(*) OVER (PARTITION BY none, source) AS part FROM d),
o AS (SELECT *, row_number() OVER (ORDER BY part, none, source, key, CAST(doc_id AS VARCHAR), crc, size) - 1 AS place, count(*) OVER () AS n FROM r)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place * 40 // n AS INTEGER) AS shard,
    CAST(row_number() OVER (PARTITION BY place * 40 // n ORDER BY place) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM o
"""

#: Runs of three words, the numbers that two sets share, and what is reached by links.
OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(3, len(w)) - 1], ' ') AS g
    FROM w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_tokenizer_fertility": op1_tokenizer_fertility,
        "op2_wu_manber": op2_wu_manber,
        "op3_soft_mixture": op3_soft_mixture,
        "op4_token_counts": op4_token_counts,
        "op5_interleaved_shards": op5_interleaved_shards,
        "op6_chat_windows": op6_chat_windows,
        "op7_block_rules": op7_block_rules,
        "op8_compression_language": op8_compression_language,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_wu_manber": OP2_SQL, "op5_interleaved_shards": OP5_SQL, "op9_jaccard_join": OP9_SQL}
