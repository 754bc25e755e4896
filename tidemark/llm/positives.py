"""A quality classifier learned from trusted positives and unlabelled text alone: non-negative unbiased risk.

Every whole text is measured once (``MEASURES``); each measure is spread over fixed knots, so that the model is a sum of
piecewise linear curves. With the squared loss all parts of the risk depend on the data only through first and second
moments of these features, one set over the trusted positives and one over all documents, which Spark sums. Nothing is
sampled: the driver holds two matrices whose size the number of features fixes.

  1. The class prior: a first model tells positives from unlabelled text; the share of unlabelled text in its upper tail
     over that of the positives is an upper bound of the prior, and the smallest such bound is taken (histograms of all rows).
  2. The model minimises prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).
  3. The score is a logistic curve of the model's response that passes ``BAR`` where errors on the labelled rows are
     fewest (histograms again), or, with under ten rows of either label, where the model puts the posterior at ``BAR``.

Labels, lang, source and doc_id are no inputs of a score, and labels come only from rows outside the held-out quarter.
Labels that are null are left out; of repeated labels of a document the smallest counts. Without positives every score is 0.
Null and empty texts have no words and get the score of the zero measures. Repeated rows count as often as they stand there
and get equal scores. Other columns aren't read. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import require, stored
from tidemark.llm.tokens import _bytes

MEASURES = ("log_words", "word_length", "upper", "digits", "symbols", "pipes", "marks", "other_punctuation", "non_ascii", "repeats", "distinct", "top_word", "same_lines", "line_words", "open_lines", "short_words", "entropy")
#: Where the curves bend: shares of something, and logarithms or lengths.
SHARES = (0.0, 0.004, 0.01, 0.02, 0.04, 0.07, 0.11, 0.16, 0.25, 0.4, 0.6, 0.8, 1.0)
LENGTHS = (0.0, 0.7, 1.4, 2.1, 2.8, 3.5, 4.2, 5.0, 6.0, 7.0, 8.5, 10.0, 14.0)
BY_LENGTH = frozenset({"log_words", "word_length", "line_words", "entropy"})
KNOTS = np.array([LENGTHS if m in BY_LENGTH else SHARES for m in MEASURES])
WIDTH = KNOTS.size + 1
#: A document is of quality from this score on.
BAR = 0.7
#: The model's weights are drawn towards 0; responses are counted in ``BINS`` bins over -SPAN .. SPAN.
RIDGE, STEPS, BINS, SPAN = 1e-4, 300, 4000, 4.0
#: The prior is bounded by tails that hold at least this share of the positives.
TAIL = 0.1

_UPPER, _LOWER, _DIGIT = (slice(ord(a), ord(b) + 1) for a, b in ("AZ", "az", "09"))
_SYMBOLS, _MARKS, _PLAIN = (np.frombuffer(x, dtype=np.uint8) for x in (b"#*$%&<>@^_~=+\\/{}[]", b"!?", b".,;:'\"()-"))


def measure(text: bytes) -> np.ndarray:
    """The measures of a whole text."""
    words = text.split()
    n = len(words)
    out = np.zeros(len(MEASURES), dtype=np.float32)
    if not n:
        return out
    bytes_ = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    upper, lower, size = bytes_[_UPPER].sum(), bytes_[_LOWER].sum(), len(text)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen = bytes_[bytes_ > 0] / size
    out[:] = (
        np.log1p(n),
        min(sum(map(len, words)) / n, 14.0),
        upper / max(1, upper + lower),
        bytes_[_DIGIT].sum() / size,
        bytes_[_SYMBOLS].sum() / size,
        bytes_[ord("|")] / n,
        bytes_[_MARKS].sum() / n,
        bytes_[_PLAIN].sum() / n,
        bytes_[128:].sum() / size,
        sum(map(eq, words, words[1:])) / n,
        len(counts) / n,
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        sum(not x.rstrip().endswith((b".", b"!", b"?", b":", b'"')) for x in lines) / len(lines),
        sum(len(x) < 4 for x in words) / n,
        float(-(seen * np.log2(seen)).sum()),
    )
    return out


def spread(measures: np.ndarray) -> np.ndarray:
    """Features of rows of measures: for each measure its weights on the two knots around it, and a constant 1."""
    n = len(measures)
    out = np.zeros((n, *KNOTS.shape))
    for j, knots in enumerate(KNOTS):
        x = np.clip(measures[:, j], knots[0], knots[-1])
        at = np.clip(np.searchsorted(knots, x, side="right") - 1, 0, len(knots) - 2)
        part = (x - knots[at]) / (knots[at + 1] - knots[at])
        out[np.arange(n), j, at] = 1 - part
        out[np.arange(n), j, at + 1] = part
    return np.concatenate([out.reshape(n, -1), np.ones((n, 1))], axis=1)


@dataclass(frozen=True)
class Moments:
    """Of a set of rows: how many, and the mean of features times their transpose (the constant's row holds the means)."""

    n: float
    second: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return self.second[-1]

    def loss(self, w: np.ndarray, y: int) -> float:
        """Mean of (response - y)^2 / 4."""
        return float(w @ self.second @ w - 2 * y * (w @ self.first) + 1) / 4

    def slope(self, w: np.ndarray, y: int) -> np.ndarray:
        return (self.second @ w - y * self.first) / 2


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    prior: float
    centre: float = 0.0
    steep: float = 1.0

    def response(self, measures: np.ndarray) -> np.ndarray:
        return (spread(measures) * self.weights).sum(axis=1)  # row by row, so that equal rows get equal scores

    def score(self, measures: np.ndarray) -> np.ndarray:
        z = self.steep * (self.response(measures) - self.centre) + np.log(BAR / (1 - BAR))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def inverse(m: np.ndarray) -> np.ndarray:
    """Of a symmetric positive definite matrix, by elimination: threaded LAPACK can hang in a process that holds a JVM."""
    n = len(m)
    a = np.concatenate([m, np.eye(n)], axis=1)
    for i in range(n):
        a[i] /= a[i, i]
        others = a[:, i].copy()
        others[i] = 0
        a -= np.outer(others, a[i])
    return a[:, n:]


def separate(positive: Moments, unlabelled: Moments) -> np.ndarray:
    """Least squares between positives (1) and unlabelled rows (-1), both weighing the same."""
    both = positive.second + unlabelled.second
    return inverse(both + RIDGE * np.eye(WIDTH)) @ (positive.first - unlabelled.first)


def risk(w: np.ndarray, positive: Moments, unlabelled: Moments, prior: float) -> tuple[float, float]:
    """prior * R+ of the positives, and what is left of the unlabelled rows' R- for negatives (below 0 by overfitting)."""
    return prior * positive.loss(w, 1), unlabelled.loss(w, -1) - prior * positive.loss(w, -1)


def minimise(positive: Moments, unlabelled: Moments, prior: float) -> np.ndarray:
    """Weights of the smallest non-negative risk met. Steps follow the plain risk while the negatives' part is 0 or more,
    and climb back along that part where it isn't; the second moments of both sets scale them."""
    metric = inverse((unlabelled.second + prior * positive.second) / 2 + RIDGE * np.eye(WIDTH))
    w, best = np.zeros(WIDTH), (np.inf, np.zeros(WIDTH))
    for _ in range(STEPS):
        kept, rest = risk(w, positive, unlabelled, prior)
        best = min(best, (kept + max(0.0, rest) + RIDGE * float(w @ w), w), key=lambda x: x[0])
        negative = unlabelled.slope(w, -1) - prior * positive.slope(w, -1)
        slope = prior * positive.slope(w, 1) + negative if rest >= 0 else -negative
        w = w - 0.2 * metric @ (slope + 2 * RIDGE * w)
    return best[1]


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from histograms of the first model's responses, low to high: over all upper tails with ``TAIL`` of
    the positives or more, the smallest ratio of shares, each with the margin of its sampling error."""
    p, u = (np.cumsum(x[::-1]) for x in (positive, unlabelled))
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(max(1, p[-1])) + 1 / np.sqrt(max(1, u[-1])))
    tails = p >= TAIL * p[-1]
    ratio = (u[tails] / max(1, u[-1]) + margin / 2) / (p[tails] / max(1, p[-1]))
    return float(np.clip(ratio.min(), 0.02, 0.98))


def cut_of(negative: np.ndarray, positive: np.ndarray) -> float:
    """The response between two bins where errors are fewest; the middle of equally good places."""
    errors = np.concatenate([[0], np.cumsum(positive)]) + np.concatenate([np.cumsum(negative[::-1])[::-1], [0]])
    fewest = np.flatnonzero(errors == errors.min())
    runs = np.split(fewest, np.flatnonzero(np.diff(fewest) > 1) + 1)
    return float(max(runs, key=len).mean() / BINS * 2 * SPAN - SPAN)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def measures_of(documents: DataFrame) -> DataFrame:
    """doc_id and measures of every text, stored."""
    rows = require(documents, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(x).tobytes() for x in _bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "measures"])

    return stored(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, measures binary"))


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("measures").to_pylist()), dtype=np.float32).reshape(-1, len(MEASURES))


_HALF = np.triu_indices(WIDTH)


def _moments(rows: DataFrame) -> dict[int, Moments]:
    """By kind (1: trusted positives, 0: all rows), summed over all tasks; two rows per feature pair reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((2, WIDTH, WIDTH)), 0
        for batch in batches:
            quality = batch.column("quality").fill_null(0).to_numpy()
            features = spread(_rows(batch))
            n += len(features)
            sums[0] += features.T @ features
            sums[1] += features[quality == 1].T @ features[quality == 1]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([s[_HALF] for s in sums], pa.list_(pa.float64()))], names=["kind", "half"])

    parts = rows.mapInArrow(run, "kind int, half array<double>")
    found = parts.select("kind", F.posexplode("half").alias("at", "x")).groupBy("kind", "at").agg(F.sum("x").alias("x")).toArrow()
    out = {}
    for kind in (0, 1):
        own = found.filter(pc.equal(found["kind"], kind))
        second = np.zeros((WIDTH, WIDTH))
        at = own["at"].to_numpy()
        second[_HALF[0][at], _HALF[1][at]] = second[_HALF[1][at], _HALF[0][at]] = own["x"].to_numpy()
        n = second[-1, -1]
        out[kind] = Moments(n, second / max(1.0, n))
    return out


def _histograms(rows: DataFrame, weights: np.ndarray) -> dict[int | None, np.ndarray]:
    """Responses in bins, by label (None: unlabelled or held out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, BINS), dtype=np.int64)
        for batch in batches:
            at = np.clip((spread(_rows(batch)) @ weights + SPAN) / (2 * SPAN) * BINS, 0, BINS - 1).astype(np.int64)
            np.add.at(counts, (batch.column("quality").fill_null(2).to_numpy(), at), 1)
        kind, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(at, pa.int32()), pa.array(counts[kind, at])], names=["kind", "at", "n"])

    found = rows.mapInArrow(run, "kind int, at int, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect()  # 3 * BINS rows at most
    out = {k: np.zeros(BINS) for k in (0, 1, None)}
    for r in found:
        out[None if r["kind"] == 2 else r["kind"]][r["at"]] = r["n"]
    return out


def train(measures: DataFrame, labels: DataFrame) -> Model:
    """Fit on stored measures (doc_id, measures) and labels (doc_id, quality)."""
    known = require(labels, "doc_id", "quality").filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("l_doc_id")).agg((F.min("quality") > 0).cast("int").alias("quality"))
    rows = stored(measures.join(known, F.col("doc_id") == F.col("l_doc_id"), "left").select("measures", "quality"))
    found = _moments(rows)
    if not found[1].n:
        return Model(np.zeros(WIDTH), 0.0, 40.0)
    counts = _histograms(rows, separate(found[1], found[0]))
    prior = prior_of(counts[1], sum(counts.values()))
    weights = minimise(found[1], found[0], prior)
    counts = _histograms(rows, weights)
    enough = min(counts[0].sum(), counts[1].sum()) >= 10
    centre = cut_of(counts[0], counts[1]) if enough else 2 * BAR - 1
    return Model(weights, prior, centre, 4.0)


def score(measures: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``measures``."""
    shared = measures.sparkSession.sparkContext.broadcast(model)  # as wide as the features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(_rows(batch)), pa.float64())], names=["doc_id", "score"])

    return measures.mapInArrow(run, f"doc_id {measures.schema['doc_id'].dataType.simpleString()}, score double")
