"""A convolutional text classifier for toxicity, trained in numpy and applied by Spark to every whole text.

Words are lower-cased, cut at white space and ASCII punctuation, and hashed to buckets; a bucket that enough training texts
use owns a vector, the others share the zero vector. Filters of several widths slide over the words; each filter keeps its
largest response (max pooling), and a logistic layer joins them. Thresholds are calibrated for each language, which is
guessed from the text's own function words; the score is shifted so that 0.5 is that language's threshold. Labels, lang,
source and doc_id are no inputs of a score.

Training uses at most ``LABELLED`` labelled documents of ``WORDS`` words together, those with the smallest hash of their
doc_id, so that the driver's memory doesn't grow with the table or its texts. Labels that are null are left out; of repeated labels of a document the largest counts.
With no labelled rows, or rows of one class only, every score is 0 (or 1, if that class is toxic). Null and empty texts
have no words and get the score of the bias. Repeated rows get equal scores; other columns aren't read.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, require
from tidemark.llm.tokens import _bytes

#: The bound on labelled rows that a model is fitted on, of which every fifth is kept for calibration.
LABELLED = 12_000
#: The bound on their words (four bytes each on the driver); rows past it, in the order of the hash, aren't used.
WORDS = 8_000_000
BUCKETS, LEAST_TEXTS = 1 << 22, 3
WIDTH, FILTERS, WIDTHS = 8, 6, (1, 2, 3)
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: Languages are groups of at most so many training texts, by so many common words, in so many rounds at most.
GROUPS, GROUPED, COMMON, ROUNDS = 8, 4_000, 512, 30
#: Words of a text that are convolved at once; blocks overlap by the longest filter.
BLOCK = 65_536

_SPLIT = bytes(32 if chr(b) in string.punctuation else b + 32 if 65 <= b <= 90 else b for b in range(256))

def word_hashes(text: bytes) -> np.ndarray:
    words = text.translate(_SPLIT).split()
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))


@dataclass
class Tongues:
    """Groups of texts that share their commonest words, which are function words of their languages; learned from texts alone.

    ``words`` are sorted hashes, ``centres`` a unit vector over them per group. A text's group is that of the greatest cosine
    with the roots of its counts, the first on ties; a text with none of the words has the number past the last group.
    """

    words: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.uint32))
    centres: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.float32))

    def profile(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        x = np.sqrt(np.bincount(at[self.words[at] == hashes], minlength=len(self.words)))
        return (x / max(np.linalg.norm(x), 1e-12)).astype(np.float32)

    def of(self, hashes: np.ndarray) -> int:
        if len(self.words) and len(hashes):
            x = self.profile(hashes)
            if x.any():
                return int((self.centres @ x).argmax())
        return len(self.centres)


def learn_tongues(texts: list[np.ndarray], seed: int = 1) -> Tongues:
    """Groups of the first ``GROUPED`` texts by k-means on the sphere, over the words that most of these texts hold."""
    texts = [t for t in texts[:GROUPED] if len(t)]
    if not texts:
        return Tongues()
    held, texts_with = np.unique(np.concatenate([np.unique(t) for t in texts]), return_counts=True)
    found = Tongues(np.sort(held[np.lexsort((held, -texts_with))[:COMMON]]))
    x = np.stack([found.profile(t) for t in texts])
    x = x[x.any(axis=1)]
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    while len(centres) < GROUPS:  # the next centre is likelier the less like the chosen ones
        far = np.square(1 - np.clip(np.max(x @ np.stack(centres).T, axis=1), 0, 1)).astype(np.float64)
        if far.sum() <= 1e-9:
            break
        centres.append(x[rng.choice(len(x), p=far / far.sum())])
    found.centres = np.stack(centres)
    for _ in range(ROUNDS):
        nearest = (x @ found.centres.T).argmax(axis=1)
        sums = np.stack([x[nearest == k].sum(axis=0) if (nearest == k).any() else c for k, c in enumerate(found.centres)])
        sums /= np.linalg.norm(sums, axis=1, keepdims=True)
        if np.allclose(sums, found.centres, atol=1e-6):
            break
        found.centres = sums
    return found


@dataclass
class Model:
    """``slots`` are the sorted buckets that own a vector; row 0 of ``vectors`` is the zero vector of the others."""

    slots: np.ndarray
    vectors: np.ndarray
    filters: list[np.ndarray]  # per width: (width, WIDTH, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(GROUPS + 1))
    tongues: Tongues = field(default_factory=Tongues)
    _table: np.ndarray | None = None
    _lookup: np.ndarray | None = None

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        if self._lookup is None:
            self._lookup = np.zeros(BUCKETS, dtype=np.int32)
            self._lookup[self.slots] = np.arange(1, len(self.slots) + 1)
        return self._lookup[hashes & np.uint32(BUCKETS - 1)]

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """Largest response of every filter; a filter meets zero vectors behind the last word."""
        if self._table is None:
            self._table = np.concatenate([self.vectors @ f[j] for f in self.filters for j in range(len(f))], axis=1)
        best = np.full(FILTERS * len(WIDTHS), -np.inf, dtype=np.float32)
        tail = max(WIDTHS) - 1
        rows = np.concatenate([rows, np.zeros(tail + (not len(rows)), dtype=rows.dtype)])
        for begin in range(0, len(rows) - tail, BLOCK):
            r = self._table[rows[begin : begin + BLOCK + tail]]
            n, at = len(r) - tail, 0
            for k, (w, b) in enumerate(zip(WIDTHS, self.biases)):
                total = r[:n, at * FILTERS : (at + 1) * FILTERS].copy()
                for j in range(1, w):
                    total += r[j : n + j, (at + j) * FILTERS : (at + j + 1) * FILTERS]
                at += w
                s = slice(k * FILTERS, (k + 1) * FILTERS)
                best[s] = np.maximum(best[s], total.max(axis=0) + b)
        return np.maximum(best, 0)

    def logit(self, rows: np.ndarray) -> float:
        return float(self.pooled(rows) @ self.out + self.bias)

    def score(self, text: bytes) -> float:
        hashes = word_hashes(text)
        z = self.logit(self.rows(hashes)) - self.thresholds[self.tongues.of(hashes)]
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def constant(value: float) -> Model:
    empty = [np.zeros((w, WIDTH, FILTERS), dtype=np.float32) for w in WIDTHS]
    return Model(np.empty(0, dtype=np.int64), np.zeros((1, WIDTH), dtype=np.float32), empty, [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS), dtype=np.float32), 40.0 if value else -40.0)


def parameters(model: Model) -> list[np.ndarray]:
    return [model.vectors, *model.filters, *model.biases, model.out]


def gradients(model: Model, rows: list[np.ndarray], labels: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Of the mean logistic loss of texts (rows of the vectors each), by ``parameters`` and by the bias."""
    tail = max(WIDTHS) - 1
    padded = [np.concatenate([r, np.zeros(tail + (not len(r)), dtype=np.int32)]) for r in rows]
    lengths = np.array([len(p) - tail for p in padded])
    ids = np.concatenate(padded)
    starts = np.concatenate([[0], np.cumsum(lengths + tail)[:-1]])
    valid = np.ones(len(ids), dtype=bool)
    for j in range(tail):
        valid[starts + lengths + j] = False
    e = model.vectors[ids]
    pooled, places = [], []
    for w, f, b in zip(WIDTHS, model.filters, model.biases):
        total = e @ f[0]
        for j in range(1, w):
            total[:-j] += (e @ f[j])[j:]
        total[~valid] = -np.inf
        top = np.maximum.reduceat(total, starts, axis=0)
        at = np.empty(top.shape, dtype=np.int64)
        for i, (s, n) in enumerate(zip(starts, lengths)):
            at[i] = s + total[s : s + n].argmax(axis=0)
        pooled.append(np.maximum(top + b, 0))
        places.append(at)
    p = np.concatenate(pooled, axis=1)
    z = p @ model.out + model.bias
    error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / len(rows)
    grads = [np.zeros_like(x) for x in parameters(model)]
    back = np.outer(error, model.out) * (p > 0)
    for k, (w, f, at) in enumerate(zip(WIDTHS, model.filters, places)):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        grads[1 + len(WIDTHS) + k][:] = g.sum(axis=0)
        for j in range(w):
            where = ids[np.minimum(at + j, len(ids) - 1)]
            grads[1 + k][j] = np.einsum("bfd,bf->df", model.vectors[where], g)
            np.add.at(grads[0], where.ravel(), (g[:, :, None] * f[j].T[None]).reshape(-1, WIDTH))
    grads[0][0] = 0  # the zero vector stays
    grads[-1][:] = p.T @ error
    return grads, float(error.sum())


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> Model:
    """Train on texts as arrays of word hashes with labels 0 and 1; every fifth text only calibrates the thresholds."""
    labels = np.asarray(labels, dtype=np.float32)
    if not len(labels) or labels.min() == labels.max():
        return constant(float(labels[0]) if len(labels) else 0.0)
    own = np.arange(len(texts)) % 5 != 0
    if labels[own].min() == labels[own].max():
        own[:] = True
    rng = np.random.default_rng(seed)
    texts_with, toxic_with = np.zeros(BUCKETS, dtype=np.int32), np.zeros(BUCKETS, dtype=np.int32)
    for t, o, y in zip(texts, own, labels):
        if o:
            held = np.unique(t & np.uint32(BUCKETS - 1))
            texts_with[held] += 1
            if y:
                toxic_with[held] += 1
    slots = np.flatnonzero(texts_with >= min(LEAST_TEXTS, len(texts)))
    vectors = np.zeros((len(slots) + 1, WIDTH), dtype=np.float32)
    vectors[1:] = rng.normal(0, 0.1, size=(len(slots), WIDTH))
    # The first coordinate begins at the word's log-odds among toxic and other training texts.
    with_any, with_toxic = texts_with[slots], toxic_with[slots]
    del texts_with, toxic_with
    n1, n0 = labels[own].sum(), (1 - labels[own]).sum()
    odds = np.log((with_toxic + 0.5) / (n1 + 1)) - np.log((with_any - with_toxic + 0.5) / (n0 + 1))
    vectors[1:, 0] = np.clip(odds, -3, 3) * np.minimum(1, with_any / 10)
    model = Model(slots, vectors, [], [], rng.normal(0, 0.3, size=FILTERS * len(WIDTHS)).astype(np.float32), float(np.log(n1 / n0)))
    for w in WIDTHS:
        f = rng.normal(0, 0.3, size=(w, WIDTH, FILTERS)).astype(np.float32)
        f[:, 0, : FILTERS // 2] = 0.6 / w
        model.filters.append(f)
        model.biases.append(np.zeros(FILTERS, dtype=np.float32))
    model.out[[k * FILTERS + i for k in range(len(WIDTHS)) for i in range(FILTERS // 2)]] = 0.3
    train = np.flatnonzero(own)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parameters(model)]
    bias_moments, step = [0.0, 0.0], 0
    for _ in range(EPOCHS):
        for begin in range(0, len(train), BATCH):
            if begin == 0:
                rng.shuffle(train)
            batch = train[begin : begin + BATCH]
            grads, g = gradients(model, [model.rows(texts[i]) for i in batch], labels[batch])
            step += 1
            scale = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for x, slope, (m, v) in zip(parameters(model), grads, moments):
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                x -= scale * m / (np.sqrt(v) + 1e-8)
            bias_moments = [bias_moments[0] + 0.1 * (g - bias_moments[0]), bias_moments[1] + 0.001 * (g * g - bias_moments[1])]
            model.bias -= float(scale * bias_moments[0] / (np.sqrt(bias_moments[1]) + 1e-8))
    model.tongues = learn_tongues([texts[i] for i in np.flatnonzero(own)])
    _calibrate(model, [texts[i] for i in np.flatnonzero(~own)] or texts, labels[~own] if (~own).any() else labels)
    model._table = model._lookup = None  # made again where the model is used
    return model


def _calibrate(model: Model, texts: list[np.ndarray], labels: np.ndarray) -> None:
    """Per group of texts (``Tongues``) the threshold with the fewest errors; a group with under ten texts of either label takes
    the one of all."""
    z = np.array([model.logit(model.rows(t)) for t in texts])
    tongues = np.array([model.tongues.of(t) for t in texts])

    def best(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(z)
        z, y = z[order], y[order]
        errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
        edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
        fewest = np.flatnonzero(errors == errors.min())
        return float(edges[fewest[np.abs(edges[fewest]).argmin()]])

    whole = best(z, labels)
    for k in range(len(model.thresholds)):
        own = tongues == k
        enough = min(labels[own].sum(), (1 - labels[own]).sum()) >= 10 if own.any() else False
        model.thresholds[k] = best(z[own], labels[own]) if enough else whole


def train(documents: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """Fit on the labelled documents outside the held-out fifth (crc32 of the doc_id as text, modulo 5)."""
    known = require(labels, "doc_id", "toxic").filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("l_doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(F.col("l_doc_id").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("l_doc_id"), "l_doc_id").limit(most)
    rows = require(documents, "doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("l_doc_id")).select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [word_hashes(x).tobytes() for x in _bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(hashes, pa.binary())], names=["doc_id", "toxic", "hashes"])

    # Rows that share a doc_id count once; the order doesn't depend on how Spark dealt them out.
    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, toxic int, hashes binary")
    found = durable(found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("hashes").alias("hashes")))
    sizes = found.select("doc_id", (F.length("hashes") / 4).alias("size"))  # at most ``most`` short rows
    ahead = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    some = sizes.withColumn("words", ahead).filter(F.col("words") <= WORDS).select("doc_id")
    found = found.join(some, "doc_id", "left_semi").toArrow().combine_chunks()
    if not found.num_rows:
        return fit([], np.empty(0))
    hashes, toxic, ids = found["hashes"].chunk(0), found["toxic"].to_numpy(), found["doc_id"].to_pylist()
    text = lambda i: np.frombuffer(hashes[i].as_buffer(), dtype=np.uint32)  # noqa: E731  views, no copies
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i]))
    return fit([text(i) for i in order], toxic[order] > 0)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every text, whole."""
    rows = require(documents, "doc_id", "text")
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by LABELLED and the width of a vector

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = [m.score(x) for x in _bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is under 0.5, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(texts):
        return texts.map(lambda x: shared.value.score((x or "").encode()))

    return documents.filter(toxicity(documents["text"]) < 0.5)
