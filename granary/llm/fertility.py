"""Quality rules: base counts of a text, and how public vocabularies cut its words.

Three measures judge a text that passes the base rules. The public byte-level
vocabulary that its language's band names cuts the whole text into tokens:

* chars_per_token: code points over tokens;
* fallback_share: tokens that are only some bytes of a character, over all;
* entropy: bits of the token distribution, over what the length allows.

Each has a band for the language, or for the script where the language has
none. Words are what ASCII blanks part, and whole texts are read. Null and empty texts have zero words, fail the base rules and
are not kept; the measures of a text without words are 0. Ties and repeated
rows get equal results, extra columns pass through, and a column that has the
name of a measure is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import added, as_bytes, row_function, session

RESULT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_tokens bigint, n_fallback bigint, chars_per_token double, fallback_share double, "
    "entropy double, band string, base_failed boolean, kept boolean"
)
BLANKS = " \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
#: Entropy is over the bits that this many tokens can have, or the text's own number if smaller.
ENTROPY_TOKENS = 512


@dataclass(frozen=True)
class Band:
    """A vocabulary, and what a kept text may have: characters a token, share of part tokens, relative entropy."""

    vocabulary: str
    low_chars: float
    high_chars: float
    max_fallback: float
    low_entropy: float


#: Bands by language, then by script. Wide of what running prose shows, so that
#: prose stays and symbol noise, unknown scripts and repeated tokens go.
ENGLISH, MANY = "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"
BANDS = {
    "en": Band(ENGLISH, 2.45, 8.0, 0.05, 0.60),
    "de": Band(MANY, 2.35, 8.0, 0.05, 0.60),
    "fr": Band(MANY, 2.15, 8.0, 0.05, 0.60),
    "es": Band(MANY, 2.10, 8.0, 0.05, 0.60),
    "latin": Band(MANY, 2.0, 9.0, 0.10, 0.55),
    "other": Band(MANY, 0.3, 9.0, 0.60, 0.45),
}
#: A band is wider for a short text, whose measures vary more: by this over the root of its tokens.
SLACK = 2.0


@cache
def vocabulary(name: str) -> tuple[Any, frozenset[int]]:
    """The encoder of a public byte-level vocabulary, and its ids that are only part of a character."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoder, frozenset(i for t, i in ranks.items() if not _whole(t))


def _whole(token: bytes) -> bool:
    try:
        token.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def base_counts(text: bytes) -> tuple[list[bytes], int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows."""
    words = text.split()
    s = text.decode("utf-8", "replace")
    chars = len(s) - sum(map(s.count, BLANKS))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return words, chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of five that occurs twice or more, its first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    key = ids[:n]
    for k in range(1, WINDOW):
        if len(known) * (int(key.max()) + 1) >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(known) + ids[k : k + n]
    ordered = np.sort(key)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return 0
    starts = np.flatnonzero(np.isin(key, again))
    return int(np.minimum(np.diff(starts), WINDOW).sum()) + WINDOW


def entropy(counts: list[int], total: int) -> float:
    """Bits of the distribution over the bits that min(total, ENTROPY_TOKENS) equal tokens have; at most 1."""
    if total < 2:
        return 0.0
    bits = math.log2(total) - sum(c * math.log2(c) for c in counts if c > 1) / total
    return min(1.0, bits / math.log2(min(total, ENTROPY_TOKENS)))


_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_LETTER = re.compile(r"[^\W\d_]")


def script(text: str) -> str:
    """latin if at least half of the letters are; a text without letters counts as latin."""
    letters = len(_LETTER.findall(text))
    return "latin" if 2 * len(_LATIN.findall(text)) >= letters else "other"


def judge(text: bytes, lang: str | None, bands: dict[str, Band]) -> tuple:
    words, chars, symbols, dup_lines, repeat = base_counts(text)
    n, s = len(words), text.decode("utf-8", "replace")
    name = lang if lang in bands else script(s)
    band = bands[name]
    encoder, partial = vocabulary(band.vocabulary)
    counts = Counter(encoder.encode_ordinary(s))
    tokens = counts.total()
    fallback = sum(counts[i] for i in counts.keys() & partial)
    per_token = len(s) / tokens if tokens else 0.0
    share = fallback / tokens if tokens else 0.0
    bits = entropy(list(counts.values()), tokens)
    slack = SLACK / math.sqrt(max(tokens, 1))
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    kept = (
        not failed
        and band.low_chars * (1 - slack) <= per_token <= band.high_chars * (1 + slack)
        and share <= band.max_fallback + slack / 4
        and bits >= band.low_entropy
    )
    return n, chars, symbols, dup_lines, repeat, tokens, fallback, per_token, share, bits, name, failed, kept


def measure(docs: DataFrame, text: str = "text", lang: str = "lang", bands: dict[str, Band] = BANDS) -> DataFrame:
    """docs with the columns of RESULT. bands needs the keys latin and other; lang may be missing from docs."""
    session(docs)
    function = row_function(lambda t, code: judge(t, code, bands), RESULT)
    code = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    return added(docs, function(as_bytes(text), code), RESULT)
