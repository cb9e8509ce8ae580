"""Token counts: a two-tier lookup on the map side, with no shuffle of pre-tokens.

The vocabulary's own pattern cuts a text into pre-tokens, whose token numbers
add up. Tier one is a compact table of frequent pre-tokens and their lengths,
broadcast to every worker: it is learnt from about SAMPLE_ROWS rows (twice as
many at most, chosen row by row) and holds at most TABLE_ENTRIES entries of at most MAX_KEY bytes, so its size is
bounded whatever the corpus. Tier two is a cache in each worker, bounded too:
what neither holds is encoded by the library and remembered. What the tables
hold changes only the time; every whole text is counted exactly.

A string that the vocabulary lists as special counts as its one token, as the
library does by default. Null and empty texts have no bytes and no tokens.
Repeated rows get equal results; other columns pass through and one with the
name of a result is replaced.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import repeat
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import SAMPLE_TASKS, added, as_bytes, mapped, row_function, session

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
RESULT = "n_bytes bigint, n_tokens bigint, over_limit boolean"
SAMPLE_ROWS = 2_000
TABLE_ENTRIES, MAX_KEY = 65_536, 48
CACHE_ENTRIES = 250_000


class Vocabulary:
    """A byte-level vocabulary file: its pattern, its special strings, and its encoder."""

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and how many special strings part them."""
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.pattern.findall(part)], len(parts) - 1

    def length(self, piece: str) -> int:
        return len(self.tokenizer.encode(piece, add_special_tokens=False).ids)


@cache
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(name)


class Lengths(dict):
    """The second tier: pre-token to number of tokens, encoded when first met."""

    def __init__(self, name: str) -> None:
        self.length = vocabulary(name).length

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        n = self.length(piece)
        if len(piece) <= MAX_KEY:
            self[piece] = n
        return n


@cache
def lengths(name: str) -> Lengths:
    return Lengths(name)


def count(name: str, frequent: dict[str, int], text: bytes, limit: int = LIMIT) -> tuple[int, int, bool]:
    pieces, tokens = vocabulary(name).pieces(text.decode("utf-8", "replace"))
    found = list(map(frequent.get, pieces, repeat(0)))
    tokens += sum(found)
    if 0 in found:
        rest = lengths(name)
        tokens += sum(rest[p] for p, n in zip(pieces, found, strict=True) if not n)
    return len(text), tokens, tokens > limit


def frequent_pieces(docs: DataFrame, text: str, name: str, rows: int, entries: int) -> dict[str, int]:
    """The first tier, from about rows sampled rows in SAMPLE_TASKS tasks that give entries pieces each at most.

    What the sample holds changes only the time, so rows are drawn where they lie, without reading their texts first.
    """

    def top(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for (data,) in batch:
                counts.update(p for p in vocabulary(name).pieces(data.decode("utf-8", "replace"))[0] if len(p.encode()) <= MAX_KEY)
        yield [(p, n, vocabulary(name).length(p)) for p, n in counts.most_common(entries) if n > 1]

    share = min(1.0, rows / max(docs.count(), 1))
    few = docs.sample(share, 7).limit(2 * rows).select(as_bytes(text).alias("t")).repartition(SAMPLE_TASKS)
    seen: Counter[str] = Counter()
    size: dict[str, int] = {}
    for piece, n, length in mapped(few, top, "piece string, n bigint, length int").collect():
        seen[piece] += n
        size[piece] = length
    return {p: size[p] for p, _ in seen.most_common(entries)}


def count_tokens(
    docs: DataFrame, text: str = "text", name: str = VOCABULARY, limit: int = LIMIT,
    sample_rows: int = SAMPLE_ROWS, entries: int = TABLE_ENTRIES,
) -> DataFrame:
    """docs with the columns of RESULT."""
    spark = session(docs)
    shared = spark.sparkContext.broadcast(frequent_pieces(docs, text, name, sample_rows, entries))
    table: Callable[[], Any] = lambda: shared.value
    return added(docs, row_function(lambda t, x: count(name, t, x, limit), RESULT, table)(as_bytes(text)), RESULT)
