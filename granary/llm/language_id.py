"""Language identification by compression.

Each language has a zstandard raw-content dictionary: sample texts of that
language. A text is compressed with each; the language of the smallest result
is predicted, and the prediction is rejected where the second best is hardly
larger. What is compressed are the letters of the whole text, in lower case,
with one blank for anything else.

The dictionaries are all that is learnt, one for every labelled language: whole
texts of it as far as DICTIONARY_BYTES go, or an equal share of ALL_BYTES where
there are many languages, from about SAMPLE_ROWS rows of it in a fixed
pseudo-random order; only of a text that is longer alone, its beginning. Ties go
to the language with more labelled rows. Null texts and texts without a letter are
`und` with score 0; so is everything if no language was learnt. Repeated rows
get equal results; a column with the name of a result is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import added, as_bytes, row_function, session, stored

RESULT = "lang_pred string, score double, margin double, rejected boolean"
DICTIONARY_BYTES, ALL_BYTES, SAMPLE_ROWS = 131_072, 67_108_864, 300
LEVEL, MIN_MARGIN = 3, 0.01
#: How fast the score follows a difference of one byte.
SHARPNESS = 0.35
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: bytes) -> bytes:
    return " ".join(_LETTERS.findall(text.decode("utf-8", "replace").lower())).encode()


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """A dictionary for each language, of sampled texts in the order of a seeded hash of their keys."""
    session(labelled)
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"),
        F.md5(F.concat(F.lit("language:"), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("at"),
        F.col(text).alias("text"),
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").toLocalIterator()}
    names = list(counts)
    room = min(DICTIONARY_BYTES, ALL_BYTES // max(len(names), 1))
    spread = F.conv(F.substring("at", 1, 8), 16, 10).cast("bigint")
    if not names:
        return {}
    # The shares as a literal, so that no text moves for the choice.
    share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, math.ceil(min(1.0, SAMPLE_ROWS / n) * 2**32))])
    chosen = rows.filter(spread < share[F.col("lang")])
    cut = row_function(lambda t: (_beginning(letters(t), room),), "d binary")(as_bytes("text"))["d"]
    sample = stored(chosen.select("lang", "at", cut.alias("d"))).orderBy("lang", "at", "d")
    out: dict[str, list[bytes]] = {}
    left = dict.fromkeys(names, room)
    for name, _, data in sample.toLocalIterator():
        if data and len(data) <= left[name]:
            out.setdefault(name, []).append(bytes(data))
            left[name] -= len(data) + 1
    return {name: b"\n".join(out[name]) for name in names if name in out}


def _beginning(data: bytes, room: int) -> bytes:
    """data, or its first words as far as room goes."""
    return data if len(data) <= room else data[:room].rpartition(b" ")[0]


def compressors(dictionaries: dict[str, bytes], level: int = LEVEL) -> dict[str, Any]:
    import zstandard

    out = {}
    for name, data in dictionaries.items():
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out[name] = zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False)
    return out


def classify(models: dict[str, Any], text: bytes, min_margin: float = MIN_MARGIN) -> tuple[str, float, float, bool]:
    data = letters(text)
    if not data or not models:
        return UNKNOWN, 0.0, 0.0, True
    sizes = sorted(((len(m.compress(data)), name) for name, m in models.items()), key=lambda x: x[0])
    best, name = sizes[0]
    total = sum(math.exp(-SHARPNESS * (s - best)) for s, _ in sizes)
    margin = (sizes[1][0] - best) / sizes[1][0] if len(sizes) > 1 else 1.0
    return name, 1 / total, margin, margin < min_margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs with the columns of RESULT; rejected marks a margin below min_margin."""
    shared = session(docs).sparkContext.broadcast(dictionaries)
    built: dict[str, Any] = {}

    def models() -> dict[str, Any]:
        if "m" not in built:
            built["m"] = compressors(shared.value)
        return built["m"]

    function: Callable = row_function(lambda m, t: classify(m, t, min_margin), RESULT, models)
    return added(docs, function(as_bytes(text)), RESULT)
