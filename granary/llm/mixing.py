"""Mixing to target weights by soft membership.

A softmax classifier, trained on labelled rows, gives each document a
posterior over domains. The rates r >= 0 of the documents then solve a
least-squares problem: the expected tokens of a domain, the sum over documents
of r * tokens * posterior, shall equal its target.

The solver is projected gradient from r = 1. Documents are measured in the
metric of their tokens, and residuals in that of the token-weighted Gram matrix
of the posteriors of the documents whose rate is not zero, so that a step of
length one meets the targets but for what the cut at zero changes. Where such a
step has made the gap larger, the next takes the matrix of all documents, in
which the objective's curvature is at most one and no step overshoots. A step
subtracts from every rate the product of the posterior with one short vector,
the same for all documents, and cuts at zero. Thus the driver holds only vectors with a number
per domain; a pass computes every document's rate from the steps so far and
returns the sums by domain. It ends when the totals match or when STALL steps
have brought the gap down by less than PROGRESS of it; the totals reached are
returned, and a warning gives the gap where it is above TOLERANCE.

The classifier is fitted on about SAMPLE_ROWS labelled rows, twice as many at
most. Its features are counted and chosen on the executors; the driver gets
the MAX_FEATURES most telling ones, ties by name, and which of them each row
has. There is no bound on domains, but the model has a weight for each feature
and domain.

A document is emitted floor(rate + u) times, u uniform in [0, 1) and fixed by
its key. Tokens are those of a column, if one is named, or else the words that
ASCII blanks part, of whole texts. Null and empty texts have no words and get
the rate of their posterior like others. Rows of one key and text get equal
rates and copies. Without labelled rows there is one domain, `all`, and its
target is what is there. Null labels and null training texts are left out; keys
may be null or repeated. No documents give none. Columns named like a result
are replaced.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import added, arrow_schema, as_bytes, fields, mapped, row_function, sampled, session, stored

SAMPLE_ROWS, MAX_FEATURES = 4_000, 40_000
MIN_ROWS, MIN_RATIO, PREFIX = 8, 1.0, 7
RATE, ROUNDS, PENALTY = 0.1, 150, 1e-4
TOLERANCE, STALL, PROGRESS = 1e-4, 8, 0.02
POSTERIOR = "n_tokens bigint, posterior array<double>"
RESULT = ("n_tokens", "posterior", "rate", "copies")
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Model:
    """Domains, the row of each feature, weights (features by domains), intercepts."""

    domains: list[str]
    places: dict[bytes, int]
    weights: np.ndarray
    intercepts: np.ndarray


def features(text: bytes) -> tuple[int, set[bytes]]:
    """The number of words; the distinct lowered words, their beginnings, and marks of the text's shape."""
    words = text.lower().split()
    out = set(words)
    out |= {b"\x00" + w[:PREFIX] for w in out if len(w) > PREFIX}
    n = max(len(text), 1)
    symbols = n - len(text.translate(None, SYMBOLS))
    lines = text.split(b"\n")
    for name, share in (
        (b"symbols", symbols / n),
        (b"upper", sum(map(text.count, (b"E", b"A", b"T", b"N", b"S"))) / n),
        (b"lines", 1 - len(set(lines)) / len(lines)),
        (b"words", 1 - len(set(words)) / max(len(words), 1)),
    ):
        out.add(b"\x00\x00%s%d" % (name, int(share * 10)))
    out.add(b"\x00\x00size%d" % len(words).bit_length())
    return len(words), out


def fit(rows: list[np.ndarray], labels: np.ndarray, chosen: list[bytes], domains: list[str]) -> Model:
    """A model from the numbers of the chosen features that each row has, and the numbers of the rows' domains."""
    n, d = len(rows), len(domains)
    y = np.zeros((n, d))
    y[np.arange(n), labels] = 1
    row, column = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows).astype(np.int64)
    w, b = np.zeros((len(chosen), d)), np.log(y.mean(0))
    squares, base = np.full_like(w, 1e-8), np.full(d, 1e-8)
    for _ in range(ROUNDS):
        z = np.stack([np.bincount(row, w[column, k], n) for k in range(d)], 1) + b
        error = softmax(z) - y
        grad = np.stack([np.bincount(column, error[row, k], len(chosen)) for k in range(d)], 1) / n + PENALTY * w
        squares += grad**2
        base += error.mean(0) ** 2
        w -= RATE * grad / np.sqrt(squares)
        b = b - RATE * error.mean(0) / np.sqrt(base)
    return Model(domains, {f: i for i, f in enumerate(chosen)}, w, b)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def posterior(model: Model, text: bytes) -> tuple[int, list[float]]:
    n, found = features(text)
    rows = [model.places[f] for f in found & model.places.keys()]
    return n, softmax(model.weights[sorted(rows)].sum(0) + model.intercepts).tolist()


def _tally(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    """(feature, domain, rows) of a task's rows (domain, features)."""
    seen: Counter[tuple[bytes, str]] = Counter()
    for batch in batches:
        for y, found in batch:
            seen.update((bytes(f), y) for f in found)
    rows = [(f, y, n) for (f, y), n in seen.items()]
    for k in range(0, len(rows), 10_000):
        yield rows[k : k + 10_000]


def learn(labelled: DataFrame, text: str = "text", domain: str = "domain", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled rows, in a fixed pseudo-random choice."""
    session(labelled)
    known = labelled.filter(F.col(domain).isNotNull() & F.col(text).isNotNull())
    made = row_function(lambda t: (sorted(features(t)[1]),), "f array<binary>")(as_bytes(text))["f"]
    sample = sampled(known, known.count(), rows, "mixing:", key, text)
    sample = stored(sample.select(F.col(domain).cast("string").alias("y"), made.alias("f")))
    numbers = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    domains, total = sorted(numbers), sum(numbers.values())
    if len(domains) < 2:
        return Model(domains or ["all"], {}, np.zeros((0, 1)), np.zeros(1))
    # A feature's share in each domain over its share in all rows; a domain without it has a share too.
    size = F.create_map(*[F.lit(x) for y, n in numbers.items() for x in (y, n)])
    seen = mapped(sample, _tally, "f binary, y string, n bigint").groupBy("f", "y").agg(F.sum("n").alias("n"))
    told = seen.withColumn("share", (F.col("n") + 1) / (size[F.col("y")] + 2)).groupBy("f").agg(
        F.sum("n").alias("c"), F.max("share").alias("most"), F.min("share").alias("least"), F.collect_set("y").alias("there")
    )
    overall = (F.col("c") + 1) / (total + 2)
    largest = F.array_max(F.transform(F.array_except(F.array(*map(F.lit, domains)), "there"), lambda y: size[y]))
    told = told.filter(F.col("c") >= MIN_ROWS).withColumn(
        "telling", F.greatest(F.log(F.col("most") / overall), F.log(overall / F.least(F.col("least"), 1 / (largest + 2))))
    )
    best = told.filter(F.col("telling") >= MIN_RATIO).orderBy(F.desc("telling"), "f").limit(MAX_FEATURES)
    chosen = sorted(bytes(r["f"]) for r in best.select("f").collect())
    shared = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(chosen)})

    def numbered(at: dict[bytes, int], found: list[bytes]) -> tuple[bytes]:
        return (np.array(sorted(at[f] for f in map(bytes, found) if f in at), np.int32).tobytes(),)

    got = sample.select("y", row_function(numbered, "f binary", lambda: shared.value)("f")["f"].alias("f"))
    found = sorted((bytes(f), y) for y, f in got.toLocalIterator())
    labels = np.array([domains.index(y) for _, y in found])
    return fit([np.frombuffer(f, np.int32) for f, _ in found], labels, chosen, domains)


def with_posteriors(docs: DataFrame, model: Model, text: str = "text", steps: list[list[float]] | None = None) -> DataFrame:
    """docs with the columns of POSTERIOR, in the order of model.domains; with steps, also the rate after them."""
    shared = session(docs).sparkContext.broadcast(model)

    def one(m: Model, t: bytes) -> tuple:
        n, p = posterior(m, t)
        return (n, p) if steps is None else (n, p, float(rates(np.array([p]), steps)[0]))

    ddl = POSTERIOR if steps is None else f"{POSTERIOR}, rate double"
    return added(docs, row_function(one, ddl, lambda: shared.value)(as_bytes(text)), ddl)


def rates(posteriors: np.ndarray, steps: list[list[float]]) -> np.ndarray:
    """The rates after the steps, from posteriors with a row for each document."""
    out = np.ones(len(posteriors))
    for s in steps:
        out = np.maximum(0.0, out - posteriors @ np.array(s))
    return out


def _matrix(column: pa.Array, domains: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, domains)


def rate_column(steps: list[list[float]], domains: int) -> Column:
    """A document's rate after the steps, from its posterior."""

    def one(posteriors: pa.Array) -> pa.Array:
        return pa.array(rates(_matrix(posteriors, domains), steps))

    return F.arrow_udf(one, "double")("posterior")


def _summed(scored: DataFrame, domains: int, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of the vectors that of gives for batches of tokens and posteriors."""
    schema = arrow_schema("k int, v double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((of(b.column(0).to_numpy().astype(float), _matrix(b.column(1), domains)) for b in batches), 0.0)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], schema=schema)

    parts = scored.select("n_tokens", "posterior").mapInArrow(run, fields("k int, v double"))
    return np.array([r["v"] for r in sorted(parts.groupBy("k").agg(F.sum("v").alias("v")).collect())])


def domain_totals(scored: DataFrame, domains: int, steps: list[list[float]]) -> np.ndarray:
    """The expected tokens of each domain at the rates after the steps."""
    return _state(scored, domains, steps)[0]


def _state(scored: DataFrame, domains: int, steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """The totals of the domains, and the Gram matrix of the documents whose rate is not zero."""

    def of(t: np.ndarray, p: np.ndarray) -> np.ndarray:
        r = rates(p, steps)
        return np.concatenate(((t * r) @ p, ((p * (t * (r > 0))[:, None]).T @ p).ravel()))

    got = _summed(scored, domains, of)
    got = got if len(got) else np.zeros(domains + domains**2)
    return got[:domains], got[domains:].reshape(domains, domains)


def solve(scored: DataFrame, targets: list[float]) -> tuple[list[list[float]], np.ndarray]:
    """The steps of the projected gradient, and the totals reached; scored is read once a step, so it should be stored."""
    d, want = len(targets), np.array(targets)
    steps: list[list[float]] = []
    gaps: list[float] = []
    whole = None
    while True:
        reached, gram = _state(scored, d, steps)
        whole = gram if whole is None else whole
        gaps.append(float(np.abs(reached - want).max()))
        if gaps[-1] <= TOLERANCE * max(want.sum(), 1.0):
            return steps, reached
        if len(gaps) > STALL and min(gaps[-STALL:]) > (1 - PROGRESS) * min(gaps[:-STALL]):
            warnings.warn(f"rates miss a target by {gaps[-1]:.6g} of {want.sum():.6g} tokens after {len(steps)} steps", stacklevel=2)
            return steps, reached
        metric = whole if len(gaps) > 1 and gaps[-1] > gaps[-2] else gram
        steps.append((np.linalg.pinv(metric, 1e-9, True) @ (reached - want)).tolist())


def anchored_targets(totals: np.ndarray, domains: list[str], weights: dict[str, float], anchor: str) -> list[float]:
    """Token targets in the ratio of weights, scaled so that the anchor domain keeps what it has.

    A domain without a weight keeps what it has; so do all if the anchor is missing or has no weight.
    """
    if anchor not in domains or not weights.get(anchor):
        return totals.tolist()
    unit = totals[domains.index(anchor)] / weights[anchor]
    return [float(weights[x] * unit) if x in weights else float(t) for x, t in zip(domains, totals, strict=True)]


@dataclass(frozen=True)
class Mixture:
    """The model; for each of its domains the target and the total that the rates reach."""

    model: Model
    targets: list[float]
    reached: list[float]


def mix(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], anchor: str, key: str = "doc_id", text: str = "text",
    keep: list[str] | None = None, seed: str = "mix:", tokens: str | None = None,
) -> tuple[DataFrame, Mixture]:
    """Documents with n_tokens, posterior, rate and copies; and what was fitted.

    labelled has text, key and domain. keep limits the columns of docs in the result. tokens names a column
    of docs with token numbers. What each step of the solver reads is written once to the shared folder, with the
    columns in keep; but where those have the text, the posteriors alone, and the texts are classified again.
    """
    model = learn(labelled, text, "domain", key)
    counted = docs if tokens is None else docs.withColumn("_n", F.coalesce(F.col(f"`{tokens}`").cast("bigint"), F.lit(0)))
    own = [c for c in (docs.columns if keep is None else keep) if c.lower() not in RESULT]

    def measured(steps: list[list[float]] | None = None) -> DataFrame:
        rows = with_posteriors(counted, model, text, steps)
        if tokens is not None:
            rows = rows.withColumn("n_tokens", F.col("_n"))
        return rows.select(*[f"`{c}`" for c in own], "n_tokens", "posterior", *(["rate"] if steps is not None else []))

    scored = measured()
    scored = stored(scored.select("n_tokens", "posterior") if text in own else scored)
    totals = domain_totals(scored, len(model.domains), [])
    targets = anchored_targets(totals, model.domains, weights, anchor)
    steps, reached = solve(scored, targets)
    at = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")) if key in own else F.lit("")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), at)), 1, 8), 16, 10)
    rated = measured(steps) if text in own else scored.withColumn("rate", rate_column(steps, len(model.domains)))
    rated = rated.withColumn("rate", F.round("rate", 9))
    copies = F.floor(F.col("rate") + draw.cast("double") / 2**32).cast("int")
    return rated.withColumn("copies", copies), Mixture(model, targets, reached.tolist())


def emitted(mixed: DataFrame) -> DataFrame:
    """Each row copies times, without the columns that mix added."""
    times = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mixed.filter("copies > 0").withColumn("_copy", times).drop("_copy", *RESULT)
