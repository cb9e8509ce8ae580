"""Exact n-gram Jaccard self-join by a partition of the universe of shingles.

A text's set holds its distinct runs of `size` words (a shorter text is one
run). Sets whose overlap is at least the threshold differ in at most
H = (1 - t) / (1 + t) * (|A| + |B|) shingles.

**Bands and segments.** Sizes fall into bands; a pair meets in the band of its
larger set, so a set is indexed in its own band and in those a partner may
have. A band has a layout (m, d): a hash deals all shingles to m segments; the
first d are indexed with their one-deletion neighbourhood (weight 2), the
others exactly (weight 1). The layout weighs H + 1 + E for the band's largest
H; as a segment breaks by as many differences as it weighs, the segments in
which two linked sets share a signature weigh E + 1 or more. A set whose size
allows only a smaller H leaves out as many of the last exact segments, in the
order of all: of two linked sets the one that leaves out more counts, so E + 1
still hold. From the number of sets in each band (counted over all rows) the
layout of least cost is taken: the signatures that a set gives, chance
meetings, and what heavy sets cost.

**First pass.** Nobody indexes the empty content, and signatures of more than
HOT sets are left out, for every set alike; so buckets are small. A set whose
segments with an empty or hot signature weigh more than E is heavy in that
band. If one of two linked sets is not heavy, a segment is left in which it
leaves out nothing, and its partner leaves out only what both would: they meet.

**Second pass.** Two heavy sets may have lost all they share, so the heavy ones
are indexed among themselves, by H + 1 + E exact segments, the empty content
included. Linked sets share E + 1 contents or more. All contents have one
order, the most shared first, and each set leaves out its first E. The last
shared content in that order has E shared ones before it, so neither leaves it
out. What a group of alike texts costs here is H + 1 rows for each at most.

**Slices.** The signatures of every parts-th segment are made, counted and
thinned out to the shared ones together, and then deleted, so the shared
folder and the shuffles hold one slice of them; each slice reads the texts.

**Candidates.** Texts with equal sets are one class, told by a 128-bit digest.
Within a bucket of equal signatures, first every member is compared with one
centre, then those of other components with the member that has most links,
and at last, block by block, all that are still in different components.
Parity sketches prove most unlinked pairs apart; the sets of the others are
made and compared. Links inside a component add nothing to it, so groups of
alike texts cost about their size, not its square; texts that share most of
their segments and yet are not linked cost a comparison of sketches for each
two of them. Every comparison is exact: a sketch only proves, and the rest are
compared on their whole sets.

A null or empty text and one without words has an empty set and no links; its
component is itself. Rows of one id are one document with several texts. A
null id gets a null component; an id that is no integer is a TypeError. Extra
columns are ignored. No rows give none. Shingles are 64-bit hashes; sets differ
by a collision about once in 10^13 pairs of texts. Hash tables and links stay
on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import (
    arrow_schema, as_bytes, deleted, discarded, fields, lower_ascii, mapped, mix, row_function, session, shingles, sieve, stored,
    stored_at, temporary, without,
)
from granary.llm.components import components

SIZE, THRESHOLD = 3, (90, 100)
#: Sets that share a signature, above which it is left out.
HOT = 64
#: The growth of a band's largest size.
GROWTH = 1.4
#: What a chance meeting costs, in signatures, and how likely two sets have a shingle in common that stands alone.
MEETING, COMMON = 4.0, 1e-6

#: Bits of a sketch; members of a block.
SKETCH, BLOCK = 2048, 512

#: cell: band * 2^32 + segment; info: 4 * (weight of hot segments that the set may have) + the segment's weight.
#: A row with a null h says that the set is heavy in the band.
SIGNATURES = "id bigint, cell bigint, info int, h bigint"


def band_tops(limit: int) -> list[int]:
    """The largest size of each band, until limit is covered."""
    tops = [1]
    while tops[-1] < limit:
        tops.append(max(tops[-1] + 1, int(tops[-1] * GROWTH)))
    return tops


@cache
def _tops(bits: int) -> np.ndarray:
    return np.array(band_tops(1 << bits))


def bands_of(n: int, threshold: tuple[int, int]) -> range:
    """The bands that a set of n shingles is indexed in: its own, and those of larger partners."""
    largest = n * threshold[1] // threshold[0]
    tops = _tops(largest.bit_length() + 1)
    return range(int(np.searchsorted(tops, n)), int(np.searchsorted(tops, largest)) + 1)


@cache
def band_sizes(band: int, threshold: tuple[int, int]) -> tuple[int, int, int]:
    """The smallest set that is indexed in a band, the largest, and the most that two of them may differ."""
    tops = _tops(20)
    while len(tops) <= band:
        tops = _tops(int(tops[-1]).bit_length() + 8)
    top, below = int(tops[band]), int(tops[band - 1]) if band else 0
    num, den = threshold
    low = -(-(below + 1) * num // den)
    return low, top, (den - num) * 2 * top // (den + num)


@cache
def layout(band: int, sets: int, threshold: tuple[int, int]) -> tuple[int, int, int]:
    """(segments, one-deletion segments, spare weight) of least cost for a band of so many sets."""
    low, top, differ = band_sizes(band, threshold)
    if not differ:  # only equal sets link, and they are one class
        return 0, 0, 0
    best = (math.inf, 0, 0, 0)
    for spare in sorted({0, 1} | {differ // part + 1 for part in (20, 8, 5, 4, 3, 2, 1)}):
        weight = differ + 1 + spare
        for m in sorted({weight, -(-weight * 7 // 8), -(-weight * 3 // 4), -(-weight * 5 // 8), -(-weight // 2)}):
            at = (low, (2 * low + top) // 3, (low + 2 * top) // 3, top)
            cost = sum(_cost(n, m, weight - m, spare, differ_of(n, band, threshold), differ, sets) for n in at)
            best = min(best, (cost, m, weight - m, spare))
    return best[1:]


def differ_of(n: int, band: int, threshold: tuple[int, int]) -> int:
    """The most that a set of n shingles and one that it links to in a band may differ."""
    num, den = threshold
    return (den - num) * (n + min(band_sizes(band, threshold)[1], n * den // num)) // (den + num)


def _cost(n: int, m: int, d: int, spare: int, mine: int, differ: int, sets: int) -> float:
    """What a set of n shingles, of which at most mine differ, costs in a layout, counted in signatures."""
    g, exact = n / m, max(0, m - d - (differ - mine))
    empty, one = math.exp(-g), math.exp(-g) * (1 + g)
    weak = exact * empty + 2 * d * one
    heavy = 1.0 if weak >= spare + 1 else math.exp(-((spare + 1 - weak) ** 2) / (2 * weak + spare + 1))
    alone = min(sets * COMMON, HOT) * (exact * g * empty + d * g * one)
    again = n + 3 * (differ + 1) + MEETING * sets * heavy * COMMON * differ
    return exact + d + d * g + MEETING * alone + heavy * again


def second_layout(band: int, threshold: tuple[int, int]) -> tuple[int, int]:
    """(segments, spare) of the second pass, of exact segments only."""
    differ = band_sizes(band, threshold)[2]
    spare = differ // 4 + 1
    return differ + 1 + spare, spare


def _last(n: int, band: int, threshold: tuple[int, int]) -> int:
    """How many of the last exact segments of a band a set of n shingles does without."""
    return band_sizes(band, threshold)[2] - differ_of(n, band, threshold)


def _segments(set_: np.ndarray, band: int, m: int, seed: int = 2) -> np.ndarray:
    scrambled = mix(set_ + np.uint64(band), seed)
    return (((scrambled >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)


def _contents(value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of the values of each segment, which are sorted by segment; 0 for an empty one."""
    sums, filled = np.zeros(len(sizes), np.uint64), np.flatnonzero(sizes)
    if len(filled):
        sums[filled] = np.add.reduceat(value, np.concatenate(([0], np.cumsum(sizes[filled])[:-1])))
    return sums


def signatures(
    set_: np.ndarray, band: int, m: int, d: int, spare: int, last: int = 0, part: int = 0, parts: int = 1
) -> Iterator[tuple[np.ndarray, ...]]:
    """(cell, info, content hash) arrays for a set in a band, and info -1 where the set is heavy for its empty contents.

    Of the segments, the last exact ones are left out, and those of one slice are given: segment % parts == part.
    """
    segment = _segments(set_, band, m)
    sizes = np.bincount(segment, minlength=m)
    weights = np.where(np.arange(m) < d, 2, 1)
    end = max(d, m - last)
    left = int((sizes[d:end] == 0).sum()) + 2 * int((sizes[:d] < 2).sum())
    if left > spare and not part:
        yield np.array([band << 32]), np.array([-1]), np.zeros(1, np.uint64)
    if parts > 1 or end < m:
        mine = (np.arange(m) % parts == part) & (np.arange(m) < end)
        set_, segment, sizes = set_[mine[segment]], segment[mine[segment]], sizes * mine
    value = mix(set_, 0)
    order = np.argsort(segment, kind="stable")
    segment, value = segment[order], value[order]
    sums = _contents(value, sizes)
    cell, info = (band << 32) + np.arange(m), 4 * max(spare - left, 0) + weights
    salt = mix(cell.astype(np.uint64), 1)
    kept = np.flatnonzero(sizes)
    yield cell[kept], info[kept], sums[kept] + salt[kept]
    if d:
        one = (segment < d) & (sizes[segment] > 1)
        at = segment[one]
        yield cell[at], info[at], sums[at] - value[one] + salt[at]


def second_signatures(set_: np.ndarray, band: int, m: int, spare: int, last: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """(cell, spare, content hash) arrays for a heavy set in a band: all segments but the last, exactly."""
    segment = _segments(set_, band, m, 3)
    value = mix(set_, 0)[np.argsort(segment, kind="stable")]
    sums = _contents(value, np.bincount(segment, minlength=m))
    cell = (band << 32) + (1 << 31) + np.arange(m)
    h = sums + mix(cell.astype(np.uint64), 1)
    yield cell[: m - last], np.full(m - last, spare), h[: m - last]


def _set_of(text: bytes, size: int) -> np.ndarray:
    return shingles(lower_ascii(text).split(), size)


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, at, n, digest) for each row of docs (id, t, at); the digest of an empty set is null."""

    def one(data: bytes) -> tuple:
        s = _set_of(data, size)
        return len(s), xxhash.xxh128_digest(s.tobytes()) if len(s) else None

    made = row_function(one, "n bigint, digest binary")(as_bytes("t"))
    return docs.select("id", "at", made.alias("s")).select("id", "at", "s.n", "s.digest")


def index(
    docs: DataFrame, size: int, threshold: tuple[int, int], sets_in_band: dict[int, int], part: int = 0, parts: int = 1
) -> DataFrame:
    """SIGNATURES of each row of docs (id, t), in the segments of a slice; h tells the cell too, but for chance."""

    def made(s: np.ndarray, _) -> Iterator[tuple[np.ndarray, ...]]:
        for band in bands_of(len(s), threshold):
            plan = layout(band, sets_in_band.get(band, 1), threshold)
            if plan[0]:
                yield from signatures(s, band, *plan, _last(len(s), band, threshold), part, parts)

    return _indexed(docs.select("id", as_bytes("t"), F.lit(0)), size, made)


def second_index(heavy: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """SIGNATURES of each row of heavy (id, t, bands), in its bands; info is the number that a set leaves out."""

    def made(s: np.ndarray, bands: list[int]) -> Iterator[tuple[np.ndarray, ...]]:
        for band in {*bands} & {*bands_of(len(s), threshold)}:
            yield from second_signatures(s, band, *second_layout(band, threshold), _last(len(s), band, threshold))

    return _indexed(heavy.select("id", as_bytes("t"), "bands"), size, made)


def _indexed(rows: DataFrame, size: int, made_of: Callable) -> DataFrame:
    schema = arrow_schema(SIGNATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            held = 0
            for doc, data, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = _set_of(data, size)
                if doc is None or not len(s):
                    continue
                for cell, info, h in made_of(s, more):
                    made.append((np.full(len(h), doc), cell, info, h))
                    held += len(h)
                if held > 100_000:
                    yield _batch(made, schema)
                    made, held = [], 0
            yield _batch(made, schema)

    return rows.mapInArrow(run, fields(SIGNATURES))


def _batch(parts: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    kinds = (np.int64, np.int64, np.int32, np.uint64)
    columns = zip(*parts, strict=True) if parts else ([np.empty(0, k)] for k in kinds)
    doc, cell, info, h = (np.concatenate(c).astype(k) for c, k in zip(columns, kinds, strict=True))
    arrays = [pa.array(doc), pa.array(cell), pa.array(info), pa.array(h.view(np.int64), mask=info < 0)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _shared(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signatures that two sets or more have, with their number c, and the (id, band) marked as heavy.

    The signatures are written once and deleted. They are counted before the join, so that the shuffle of the one
    is gone when that of the other begins.
    """
    written, path = stored_at(found)
    many = written.filter("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    many = stored(many.withColumnRenamed("h", "h_m"))
    shared = stored(written.join(many, F.col("h") == F.col("h_m")).select("id", "cell", "info", "h", "c"))
    marked = stored(written.filter("h is null").select("id", F.shiftright("cell", 32).alias("band")))
    deleted(found.sparkSession, path)
    discarded(many)
    return shared, marked


def _heavy(shared: DataFrame) -> DataFrame:
    """(id, band) of the sets whose hot segments weigh more than what they may leave out."""
    weighed = shared.filter(F.col("c") > HOT).groupBy("id", "cell").agg(
        (F.max("info") % 4).alias("weight"), F.min(F.shiftright("info", 2)).alias("room")
    )
    totals = weighed.groupBy("id", F.shiftright("cell", 32).alias("band")).agg(
        F.sum("weight").alias("w"), F.min("room").alias("room")
    )
    return totals.filter("w > room").select("id", "band")


def _members(texts: DataFrame, size: int, threshold: tuple[int, int], counts: dict[int, int], parts: int) -> DataFrame:
    """(id, cell, h): the buckets of both passes."""
    slices = [_shared(index(texts, size, threshold, counts, part, parts)) for part in range(parts)]
    shared = reduce(DataFrame.union, [s for s, _ in slices])
    heavy = _heavy(shared).union(slices[0][1]).groupBy(F.col("id").alias("i")).agg(F.collect_set("band").alias("bands"))
    heavy = stored(heavy)
    kept = shared.filter(F.col("c") <= HOT).select("id", "cell", "h")
    if heavy.isEmpty():
        return kept
    held = sieve(heavy.select("i"))(texts, "id")
    again, _ = _shared(second_index(held.join(heavy, F.col("id") == F.col("i")), size, threshold))
    order = Window.partitionBy("id", F.shiftright("cell", 32)).orderBy(F.desc("c"), "h", "cell")
    left = again.withColumn("at", F.row_number().over(order)).filter("at > info")
    members = stored(kept.union(left.select("id", "cell", "h")))
    discarded(heavy, again, *[x for both in slices for x in both])
    return members


def _pairs(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _star(members: DataFrame, centres: DataFrame) -> DataFrame:
    """Pairs of each bucket's centre with its other members."""
    on = (F.col("cell") == F.col("cell_c")) & (F.col("h") == F.col("h_c")) & (F.col("id") != F.col("centre"))
    named = centres.select(F.col("cell").alias("cell_c"), F.col("h").alias("h_c"), "centre")
    return members.join(named, on).select(*_pairs("id", "centre")).distinct()


def _overlap(threshold: tuple[int, int]):
    num, den = threshold

    def one(x: bytes, y: bytes) -> tuple[bool]:
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if min(len(a), len(b)) * den < num * max(len(a), len(b)):
            return (False,)
        at = np.searchsorted(a, b)
        at[at == len(a)] = 0
        both = int((a[at] == b).sum())
        return (den * both >= num * (len(a) + len(b) - both),)

    return row_function(one, "linked boolean")


def _near(threshold: tuple[int, int]):
    """A column function: whether the sizes and wide sketches of two sets leave it open that they link."""
    num, den = threshold

    def one(n_a: int, x: bytes, n_b: int, y: bytes) -> tuple[bool]:
        most = (den - num) * (n_a + n_b) // (den + num)
        if abs(n_a - n_b) > most:
            return (False,)
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        bits = min(len(a), len(b))
        folded = [np.bitwise_xor.reduce(w.reshape(-1, bits), axis=0) for w in (a, b)]
        return (int(np.bitwise_count(folded[0] ^ folded[1]).sum()) <= most,)

    return row_function(one, "near boolean")


class Texts:
    """What pairs are compared by: marks (id, n, sketch, wide) of every member, and the sets of those asked for.

    Texts are picked by a sieve of the ids, where they are; the few others that pass are in no pair.
    """

    def __init__(self, docs: DataFrame, size: int) -> None:
        self.docs, self.size = docs, size

    def _of(self, ids: DataFrame, function, ddl: str) -> DataFrame:
        """The fields of ddl for each text of ids (one column), and for a few others."""
        wanted = stored(ids.distinct())
        chosen = sieve(wanted)(self.docs, "id")
        made = chosen.select("id", row_function(function, ddl)(as_bytes("t")).alias("m"))
        out = stored(made.select("id", "m.*"))
        discarded(wanted)
        return out

    def mark(self, ids: DataFrame) -> None:
        size = self.size
        self.marks = self._of(ids, lambda t: _marks(_set_of(t, size)), "n bigint, sketch binary, wide binary")

    def sets(self, ids: DataFrame) -> DataFrame:
        size = self.size
        return self._of(ids, lambda t: (_set_of(t, size).tobytes(),), "s binary")


def _beside(pairs: DataFrame, of_id: DataFrame) -> DataFrame:
    """pairs (a, b) with the columns of of_id for both, ending in _a and _b."""
    for side in ("a", "b"):
        named = of_id.select(*[F.col(c).alias(f"{c}_{side}") for c in of_id.columns])
        pairs = pairs.join(named, F.col(side) == F.col(f"id_{side}"))
    return pairs


def _verified(pairs: DataFrame, texts: Texts, threshold: tuple[int, int]) -> DataFrame:
    """pairs (a, b) with linked. Where the sketches leave it open, the whole sets of both are compared."""
    marked = _beside(pairs, texts.marks.select("id", "n", "wide"))
    near = stored(marked.select("a", "b", _near(threshold)("n_a", "wide_a", "n_b", "wide_b")["near"].alias("near")))
    left = near.filter("near").select("a", "b").distinct()
    sets = texts.sets(left.select("a").union(left.select("b")))
    exact = _beside(left, sets).select("a", "b", _overlap(threshold)("s_a", "s_b")["linked"].alias("linked"))
    out = stored(exact.union(near.filter(~F.col("near")).select("a", "b", F.lit(False).alias("linked"))))
    discarded(near, sets)
    return out


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their labels, of buckets that still hold more than one component."""
    named = labels.select(F.col("id").alias("i"), "label")
    labelled = members.join(named, F.col("id") == F.col("i"), "left").select(
        "id", "cell", "h", F.coalesce("label", "id").alias("label")
    )
    mixed = labelled.groupBy("cell", "h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    mixed = mixed.select(F.col("cell").alias("cell_x"), F.col("h").alias("h_x"))
    return stored(labelled.join(mixed, (F.col("cell") == F.col("cell_x")) & (F.col("h") == F.col("h_x"))).select("id", "cell", "h", "label"))


def _crossing(pairs: DataFrame, labels: DataFrame, tried: DataFrame) -> DataFrame:
    """The pairs between components that were not compared before."""
    la = labels.select(F.col("id").alias("ia"), F.col("label").alias("la"))
    lb = labels.select(F.col("id").alias("ib"), F.col("label").alias("lb"))
    named = pairs.join(la, F.col("a") == F.col("ia"), "left").join(lb, F.col("b") == F.col("ib"), "left")
    across = named.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    return across.join(tried.select("a", "b"), ["a", "b"], "left_anti")


def _parities(set_: np.ndarray, bits: int) -> bytes:
    """Bits that tell for each place whether an odd number of shingles falls on it.

    bits is a power of two; the exclusive or of the halves is the same with half as many.
    """
    places = (mix(set_, 1) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=bits).astype(np.uint8) & 1).tobytes()


def _marks(set_: np.ndarray) -> tuple[int, bytes, bytes]:
    """A set's size, its sketch of SKETCH bits, and a wide one of as many bits as shingles or more."""
    wide = max(SKETCH, 1 << max(len(set_) - 1, 0).bit_length())
    return len(set_), _parities(set_, SKETCH), _parities(set_, wide)


def _close(left: DataFrame, marks: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs of a bucket in different components, but for those that their sketches prove apart.

    Two sketches differ in no more places than the sets differ in shingles. A bucket is dealt to blocks of
    about BLOCK members, and every two blocks meet in a group of their own, whatever the bucket's size.
    """
    num, den = threshold
    sized = left.groupBy("cell", "h").agg(F.count(F.lit(1)).alias("c")).select(
        F.col("cell").alias("cell_s"), F.col("h").alias("h_s"), F.ceil(F.col("c") / BLOCK).alias("blocks")
    )
    marks = marks.select(F.col("id").alias("i"), "n", "sketch")
    dealt = left.join(sized, (F.col("cell") == F.col("cell_s")) & (F.col("h") == F.col("h_s"))).join(marks, F.col("id") == F.col("i"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("cell", "h", F.least("block", "other"), F.greatest("block", "other")).alias("group"),
        (F.col("block") <= F.col("other")).alias("first"), (F.col("block") >= F.col("other")).alias("second"),
        "id", "label", "n", "sketch",
    )

    def compare(rows: list[tuple]) -> list[tuple]:
        ids, labels, n = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
        bits = np.frombuffer(b"".join(r[6] for r in rows), np.uint64).reshape(len(rows), -1)
        second = np.array([r[2] for r in rows])
        out = []
        for k, r in enumerate(rows):
            most = (den - num) * (n[k] + n) // (den + num)
            near = np.flatnonzero(r[1] & second & (labels != labels[k]) & (np.abs(n - n[k]) <= most))
            if len(near):
                apart = np.bitwise_count(bits[near] ^ bits[k]).sum(1)
                out += [(min(r[3], x), max(r[3], x)) for x in ids[near[apart <= most[near]]].tolist()]
        return out

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for _, group in groupby((r for batch in batches for r in batch), key=lambda r: r[0]):
            yield compare(list(group))

    ordered = dealt.repartition("group").sortWithinPartitions("group")
    return mapped(ordered, run, "a bigint, b bigint").distinct()


def _connected(members: DataFrame, texts: Texts, threshold: tuple[int, int]) -> DataFrame:
    """(id, label) of the sets that have links."""
    first = members.groupBy("cell", "h").agg(F.min("id").alias("centre"))
    tried = _verified(_star(members, first), texts, threshold)
    labels = components(tried.filter("linked"))
    left = _open(members, labels)
    if left.isEmpty():
        return labels
    links = tried.filter("linked")
    degree = links.select(F.col("a").alias("d")).union(links.select("b")).groupBy("d").agg(F.count(F.lit(1)).alias("links"))
    ranked = left.join(degree, F.col("id") == F.col("d"), "left")
    most = F.max_by("id", F.struct(F.coalesce("links", F.lit(0)), -F.col("id")))
    hubs = ranked.groupBy("cell", "h").agg(most.alias("centre"))
    second = _verified(_crossing(_star(left, hubs), labels, tried), texts, threshold)
    tried = tried.union(second)
    labels = components(tried.filter("linked"))
    left = _open(left.select("id", "cell", "h"), labels)
    if left.isEmpty():
        return labels
    rest = _close(left, texts.marks, threshold)
    third = _verified(_crossing(rest, labels, tried), texts, threshold)
    return components(tried.union(third).filter("linked"))


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, t, at): at tells the texts of one id apart."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be a column of integers, not {docs.schema[key].dataType.simpleString()}")
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("t"), F.xxhash64(f"`{text}`").alias("at"))


def _labelled(docs: DataFrame, size: int, threshold: tuple[int, int], key: str, text: str, parts: int) -> DataFrame:
    """(id, at, n, label) for each row of docs."""
    session(docs)
    texts = _texts(docs, key, text)
    rows = stored(shingle_sets(texts, size))
    classes = rows.filter("digest is not null and id is not null").groupBy("digest").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("c"), F.first("n").alias("n")
    )
    repeated = stored(classes.filter("c > 1").select(F.col("digest").alias("same"), "rep"))
    # A number for each band, of which there are some dozens.
    sizes = classes.groupBy("n").count()
    counts = {b: int(c) for b, c in sizes.select(_band(F.col("n")).alias("b"), "count").groupBy("b").agg(F.sum("count")).collect()}
    # Copies are indexed under their representative: of equal sets, only one row's signatures stay.
    copies = rows.join(repeated, F.col("digest") == F.col("same")).filter("id <> rep")
    copies = stored(copies.select(F.col("id").alias("copy"), F.col("at").alias("copy_at")).distinct())
    if not counts:
        return rows.select("id", "at", "n", F.col("id").alias("label"))
    single = without(texts, copies, F.col("id"), F.col("at"))
    members = _members(single, size, threshold, counts, parts)
    compared = Texts(texts, size)
    compared.mark(members.select("id"))
    labels = _connected(members, compared, threshold)
    joined = rows.join(repeated, F.col("digest") == F.col("same"), "left").withColumn("node", F.coalesce("rep", "id"))
    named = labels.select(F.col("id").alias("linked"), "label")
    out = joined.join(named, F.col("node") == F.col("linked"), "left")
    return out.select("id", "at", "n", F.coalesce("label", "node").alias("label"))


def jaccard_components(
    docs: DataFrame, size: int = SIZE, threshold: tuple[int, int] = THRESHOLD, key: str = "doc_id", text: str = "text",
    parts: int = 1,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs; the first column has the key's name.

    threshold is a fraction (numerator, denominator); parts is the number of slices. Rows are read once and
    then once a slice, and the texts that share a signature with another once more.
    """
    out = _labelled(docs, size, threshold, key, text, parts)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"))


def _band(n):
    """The band of a size, as index() takes it."""
    tops = _tops(24).tolist()
    at = F.lit(0)
    for t in tops:
        at = at + F.when(n > t, 1).otherwise(0)
    return at


def representatives(
    docs: DataFrame, size: int, threshold: tuple[int, int], key: str = "doc_id", text: str = "text", parts: int = 1
) -> DataFrame:
    """docs with one row for each component: that of the least id. Rows with a null id all stay.

    Of the rows of that id, one stays for each different text. A column of docs may have any name but the four of the joins here,
    _drop, _drop_at, _again and _again_at.
    """
    with temporary(docs.sparkSession) as lasting:
        found = _labelled(docs, size, threshold, key, text, parts)
        drop = stored(found.filter("id <> label").select(F.col("id").alias("_drop"), F.col("at").alias("_drop_at")).distinct())
        again = found.filter("id = label").groupBy("id", "at").count().filter("count > 1")
        again = stored(again.select(F.col("id").alias("_again"), F.col("at").alias("_again_at")))
        lasting += [drop, again]
    same = F.col(f"`{key}`").cast("bigint"), F.xxhash64(f"`{text}`")
    kept = without(docs, drop, *same)
    if again.limit(1).count() == 0:
        return kept
    repeated = (same[0] == F.col("_again")) & (same[1] == F.col("_again_at"))
    whole = F.struct(*[f"`{c}`" for c in docs.columns])
    first = sieve(again)(kept, *same).join(again, repeated, "left_semi").groupBy(same[0].alias("_k"), same[1].alias("_t")).agg(
        F.min_by(whole, F.xxhash64(whole)).alias("_row")
    )
    return without(kept, again, *same).union(first.select("_row.*"))
