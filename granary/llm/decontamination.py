"""Benchmark decontamination: Wu-Manber search for word windows of test items.

Symbols of the search are words (runs of digits, a-z and characters beyond
ASCII, after A-Z are lowered). A pattern is a window of eight consecutive words
of an item; an item with fewer words is one shorter pattern. Patterns of one
length share a searcher: its shift table, indexed by the hash of a block of two
words, says how far the window may move, so that most positions of a text are
never looked at; a block that may end a pattern leads to the bucket of that
suffix, sorted by the patterns' first blocks; direct comparison of the words
confirms an occurrence.

The documents are read where they lie: nothing of them is shuffled. Items come
through the driver and go to the workers in groups of at most GROUP_BYTES of
text (a longer item is a group alone), in tables of about ten bytes for each
byte of text. If there is one group, one projection does all. If there are
more, each is a pass of its own over the documents, one after the other: the
findings of texts with hits are written under the text's MD5, the group is
destroyed everywhere, and at the end the findings are merged and joined to the
documents. So no worker ever holds two groups.

Null and empty texts have no words and no hits. An item without words is never
found. Repeated items each count; repeated rows of documents get equal
results. Null item ids are left out. No documents give none. Other columns pass
through; one with the name of a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import added, as_bytes, mix, row_function, session, stored, word_hashes

WINDOW, MIN_ITEMS = 8, 2
#: Text of one group of items at most; a longer item is a group alone.
GROUP_BYTES = 4_000_000
FOUND = "n_words bigint, spans array<struct<start:int,end:int>>, item_ids array<string>"
RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
#: Places of a shift table for each pattern.
PLACES = 16

#: Lower case for A-Z, a blank for every other ASCII character that is not a digit or letter.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each block of one or two words, by its first word."""
    return mix(hashes, 0) if size == 1 else mix(mix(hashes[:-1], 0) + hashes[1:], 1)


class Searcher:
    """Wu-Manber tables for patterns of one length: windows of the words of a group of items."""

    def __init__(self, length: int, starts: np.ndarray, items: np.ndarray, hashes: np.ndarray) -> None:
        """starts are the patterns' first words, items their items' numbers, hashes those of all words of the group."""
        self.length, self.block = length, min(2, length)
        blocks = _blocks(hashes, self.block)
        far = length - self.block + 1
        self.mask = np.uint64((1 << int(PLACES * len(starts)).bit_length()) - 1)
        self.shift = np.full(int(self.mask) + 1, far, np.uint8)
        for k in range(far):
            self.shift[blocks[starts + k] & self.mask] = far - 1 - k
        suffix, prefix = blocks[starts + far - 1], blocks[starts]
        order = np.lexsort((prefix, suffix))
        self.suffix, self.prefix, self.starts, self.items = suffix[order], prefix[order], starts[order], items[order]

    def find(self, group: Group, words: list[bytes], hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, end, item) of every occurrence, in order of the end."""
        n, size, length = len(words), self.block, self.length
        if n < length:
            return
        blocks = _blocks(hashes, size)
        steps, end = self.shift[blocks & self.mask].tobytes(), length
        while end <= n:
            step = steps[end - size]
            if step:
                end += step
                continue
            start, last = end - length, blocks[end - size]
            low, high = np.searchsorted(self.suffix, last), np.searchsorted(self.suffix, last, "right")
            if low < high:
                ranked = self.prefix[low:high]
                first, after = np.searchsorted(ranked, blocks[start]), np.searchsorted(ranked, blocks[start], "right")
                said = b" ".join(words[start:end]) if first < after else b""
                for k in range(low + first, low + after):
                    if group.words(self.starts[k], length) == said:
                        yield start, end, int(self.items[k])
            end += 1


class Group:
    """The words of a group of items, and a searcher for each length of pattern that they give."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW) -> None:
        words: list[bytes] = []
        self.ids: list[str] = []
        by_length: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for number, (item, text) in enumerate(items):
            own = words_of(text)
            self.ids.append(item)
            if own:
                length = min(window, len(own))
                starts, numbers = by_length.setdefault(length, ([], []))
                starts.append(np.arange(len(words), len(words) + len(own) - length + 1, dtype=np.int32))
                numbers.append(np.full(len(own) - length + 1, number, np.int32))
                words += own
        self.text = b" ".join(words)
        self.at = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int32, len(words))) - np.int32(1)
        hashes = word_hashes(words)
        self.searchers = [
            Searcher(n, np.concatenate(starts), np.concatenate(numbers), hashes) for n, (starts, numbers) in sorted(by_length.items())
        ]

    def words(self, first: int, count: int) -> bytes:
        """Words of the group, joined by blanks."""
        return self.text[self.at[first - 1] + 1 if first else 0 : self.at[first + count - 1]]

    def search(self, text: bytes) -> tuple:
        """The fields of FOUND for a text."""
        words = words_of(text)
        hashes = word_hashes(words)
        found: set[int] = set()
        spans: list[list[int]] = []
        for start, end, item in sorted(h for s in self.searchers for h in s.find(self, words, hashes)):
            found.add(item)
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], end)
            else:
                spans.append([start, end])
        return len(words), [{"start": a, "end": b} for a, b in spans], sorted({self.ids[k] for k in found})


def item_groups(benchmark: DataFrame, item_id: str, text: str, group_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in groups of bounded size, fetched a partition at a time; one empty group if there are none."""
    rows = benchmark.select(F.col(item_id).cast("string"), as_bytes(text)).filter(F.col(item_id).isNotNull())
    group: list[tuple[str, bytes]] = []
    size = 0
    for item, data in rows.toLocalIterator():
        if group and size + len(data) > group_bytes:
            yield group
            group, size = [], 0
        group.append((item, bytes(data)))
        size += len(data)
    yield group


def _pass(spark: SparkSession, items: list[tuple[str, bytes]], window: int):
    """A column function of FOUND for one group, and the group's broadcast."""
    shared = spark.sparkContext.broadcast(items)
    built: dict[str, Group] = {}

    def group() -> Group:
        if "group" not in built:
            built["group"] = Group(shared.value, window)
        return built["group"]

    return row_function(lambda g, x: g.search(x), FOUND, group), shared


def locate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """docs with FOUND: its words, the word spans that hits cover, and the items found, sorted as strings."""
    spark = session(docs)
    groups = item_groups(benchmark, item_id, item_text, group_bytes)
    first, second = next(groups), next(groups, None)
    if second is None:
        return added(docs, _pass(spark, first, window)[0](as_bytes(text)), FOUND)
    name = F.md5(as_bytes(text))
    findings = []
    for items in _chained(first, second, groups):
        function, shared = _pass(spark, items, window)
        hit = docs.select(name.alias("m"), function(as_bytes(text)).alias("f")).filter("size(f.item_ids) > 0")
        findings.append(stored(hit.select("m", "f.spans", "f.item_ids").dropDuplicates(["m"])))
        shared.destroy()
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    merged = reduce(DataFrame.union, findings).groupBy(F.col("m").alias("_m")).agg(
        F.aggregate(spans, F.expr("CAST(array() AS array<struct<start:int,end:int>>)"), _merge).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("_item_ids"),
    )
    words = row_function(lambda x: (len(words_of(x)),), "n bigint")(as_bytes(text))["n"]
    joined = docs.join(stored(merged), name == F.col("_m"), "left")
    found = F.struct(
        words.alias("n_words"),
        F.coalesce("_spans", F.expr("CAST(array() AS array<struct<start:int,end:int>>)")).alias("spans"),
        F.coalesce("_item_ids", F.expr("CAST(array() AS array<string>)")).alias("item_ids"),
    )
    return added(joined, found, FOUND).drop("_m", "_spans", "_item_ids")


def _chained(first: list, second: list, rest: Iterator[list]) -> Iterator[list]:
    yield first
    yield second
    yield from rest


def _merge(done, span):
    last = F.element_at(done, -1)
    joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
    touches = (F.size(done) > 0) & (span["start"] <= F.try_element_at(done, F.lit(-1))["end"])
    return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
        F.concat(done, F.array(span))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS, **options) -> DataFrame:
    """docs with FOUND and RESULT; contaminated means that at least min_items items occur."""
    found = locate(docs, benchmark, **options)
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("bigint")
    n_items = F.size("item_ids").cast("bigint")
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.withColumns(
        {"n_hit": hit, "n_items": n_items, "items_sha256": digest, "contaminated": n_items >= min_items}
    )

