"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of three, five and seven bytes of the text, A-Z
lowered and other ASCII that is no letter made one blank, hashed to 2^BITS
places. The log of the ratio of a feature's smoothed share among toxic and
among other training texts scales it; a logistic regression with an L2 penalty
is fitted on the scaled features that tell most. Whole texts are read in training and scoring.

Training takes about SAMPLE_ROWS labelled rows and never more than twice as
many, in a fixed pseudo-random choice; all else is per row. Features are
counted and chosen on the executors; the driver gets the MAX_FEATURES with the
largest ratios and, of each training row, which of those it has. Without labels
of both kinds every score is 0. Null and empty texts have no features: their
score is that of the model's intercept. Null labels and null training texts are
ignored, keys may be null or repeated, repeated rows get equal scores, no rows
give none, and a column with the name of a result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import added, as_bytes, mapped, row_function, sampled, session, stored

RESULT = "score double, predicted int"
BITS, SIZES = 20, (3, 5, 7)
SAMPLE_ROWS, THRESHOLD = 4_000, 0.7
SMOOTHING, PENALTY, RATE, ROUNDS = 1.0, 1e-4, 0.1, 150
#: Features in fewer training rows, or with a smaller log ratio, get no weight.
MIN_ROWS, MIN_RATIO, MAX_FEATURES = 8, 1.5, 65_536
_OTHER = re.compile(rb"[\x00-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Model:
    """A weight for each place (already times its ratio), and the intercept."""

    weights: np.ndarray
    intercept: float


def codes(text: bytes) -> np.ndarray:
    """The hashed n-grams of a text, size by size; a place may occur often."""
    data = np.frombuffer(b" " + _OTHER.sub(b" ", text.lower()) + b" ", np.uint8).astype(np.uint64)
    code, out = np.zeros(len(data), np.uint64), []
    for k in range(min(max(SIZES), len(data))):
        code = code[: len(data) - k] * np.uint64(257) + data[k:] + np.uint64(1)
        if k + 1 in SIZES:
            out.append((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def features(text: bytes) -> np.ndarray:
    """The distinct hashed n-grams of a text, sorted."""
    return np.unique(codes(text)).astype(np.int32)


def fit(rows: list[np.ndarray], labels: np.ndarray, places: np.ndarray, ratio: np.ndarray) -> Model:
    """A model from the numbers of the chosen features that each row has; places and ratio are theirs."""
    row, column = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows).astype(np.int64)
    n, width = len(rows), len(places)
    w, b = np.zeros(width), float(np.log(labels.mean() / (1 - labels.mean())))
    gw, gb = np.full(width, 1e-8), 1e-8
    for _ in range(ROUNDS):
        z = np.bincount(row, (w * ratio)[column], n) + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        grad = np.bincount(column, error[row], width) * ratio / n + PENALTY * w
        gw += grad * grad
        gb += float(error.mean()) ** 2
        w -= RATE * grad / np.sqrt(gw)
        b -= RATE * float(error.mean()) / np.sqrt(gb)
    weights = np.zeros(1 << BITS, np.float32)
    weights[places] = w * ratio
    return Model(weights, b)


def score(model: Model, text: bytes, threshold: float = THRESHOLD) -> tuple[float, int]:
    if model.intercept == -np.inf:
        return 0.0, 0
    places = codes(text)
    places = np.unique(places[model.weights[places] != 0])
    z = float(model.weights[places].sum()) + model.intercept
    p = 1 / (1 + float(np.exp(-np.clip(z, -500, 500))))
    return p, int(p >= threshold)


def _tally(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    """(place, toxic rows, other rows) of a task's rows (toxic, features)."""
    seen = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for y, f in batch:
            seen[int(y), np.frombuffer(f, np.int32)] += 1
    places = np.flatnonzero(seen.any(0))
    for k in range(0, len(places), 10_000):
        at = places[k : k + 10_000]
        yield list(zip(at.tolist(), seen[1, at].tolist(), seen[0, at].tolist(), strict=True))


def learn(labelled: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """labelled has a text, a label and a key in each row."""
    session(labelled)
    known = labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    made = row_function(lambda t: (features(t).tobytes(),), "f binary")(as_bytes(text))
    sample = sampled(known, known.count(), rows, "toxicity:", key, text)
    sample = stored(sample.select((F.col(label).cast("int") > 0).alias("y"), made.alias("x")).select("y", "x.f"))
    numbers = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(numbers) < 2:
        return Model(np.zeros(1 << BITS, np.float32), -np.inf)
    p = (F.sum("toxic") + SMOOTHING) / (numbers[True] + 2 * SMOOTHING)
    q = (F.sum("other") + SMOOTHING) / (numbers[False] + 2 * SMOOTHING)
    seen = mapped(sample, _tally, "place int, toxic bigint, other bigint").groupBy("place")
    told = seen.agg(F.log(p / q).alias("ratio"), F.sum(F.col("toxic") + F.col("other")).alias("c"))
    told = told.filter((F.col("c") >= MIN_ROWS) & (F.abs("ratio") >= MIN_RATIO))
    best = sorted(told.orderBy(F.desc(F.abs("ratio")), "place").limit(MAX_FEATURES).select("place", "ratio").collect())
    places, ratio = np.array([r[0] for r in best], np.int32), np.array([r[1] for r in best])
    shared = sample.sparkSession.sparkContext.broadcast(places)

    def chosen(there: np.ndarray, f: bytes) -> tuple[bytes]:
        return (np.flatnonzero(np.isin(there, np.frombuffer(f, np.int32), assume_unique=True)).astype(np.int32).tobytes(),)

    got = sample.select("y", row_function(chosen, "f binary", lambda: shared.value)("f")["f"].alias("f"))
    found = sorted((bytes(f), float(y)) for y, f in got.toLocalIterator())
    return fit([np.frombuffer(f, np.int32) for f, _ in found], np.array([y for _, y in found]), places, ratio)


def rate(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the columns of RESULT."""
    shared = session(docs).sparkContext.broadcast(model)
    return added(docs, row_function(lambda m, t: score(m, t, threshold), RESULT, lambda: shared.value)(as_bytes(text)), RESULT)
