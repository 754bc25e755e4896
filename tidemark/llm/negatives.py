"""Hard negatives by the threshold algorithm: rows that score close below an anchor's positives but bear another label.

Rows are dealt into shards of one label and about ``SHARD`` rows; a label with more rows has more shards. A shard keeps one
list of its rows per dimension, sorted by that component. For an anchor it reads all lists side by side, each from the end
that the sign of the anchor's component asks for, scores every row when it first meets it (integer inner product, random
access), and stops once the threshold, the score of a row that had the last read value in every dimension, falls strictly
below the kth score of what is searched: equal scores are all seen, so ties by vec_id are right. Each shard gives its own
first k, and the first k of these are the first k of all.

Positives are searched in the shards of the anchor's label. Negatives are searched in all others, for every positive at
once, inside the window that its score opens. Anchors meet shards in blocks of ``BLOCK``.

Rows with a null id, label or vector, or a null or non-finite component take no part; shorter vectors count as ending in
zeros; equal rows (id, label and vector) count once, and rows that share only the id are different rows. Scores are exact;
one that passes 64 bits is an error, as the result has no column for it. Empty tables give no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import require, stored

SHARD, BLOCK = 8192, 512
#: Positives per anchor, negatives per positive, and the window in hundredths of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Rows of each list that are read first; then twice as many, and so on.
DEPTH = 8


class Shard:
    """``ids`` and ``vectors`` (whole numbers as doubles) with one sorted list per dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        self.lists = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, self.lists, axis=0)
        self.most = float(np.abs(vectors).max(initial=0))

    def score(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.most * float(np.abs(anchor).max(initial=0)) * max(1, len(anchor)) < 2**53:
            return (self.vectors[at] @ anchor).astype(np.int64)  # every partial sum is a whole number that a double holds
        whole = [int(x) for x in anchor]
        return np.array([sum(int(x) * y for x, y in zip(self.vectors[i], whole)) for i in at], dtype=object)

    def read(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """Rows as they are first met, their scores, and the threshold behind them (None once all are met)."""
        n, up, down = len(self.ids), np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen, depth, begin = np.zeros(n, dtype=bool), min(DEPTH, n), 0
        while begin < n and len(up) + len(down):
            new = np.zeros(n, dtype=bool)
            new[self.lists[n - depth : n - begin, up]] = True
            new[self.lists[begin:depth, down]] = True
            new &= ~seen
            seen |= new
            at = np.flatnonzero(new)
            last = np.zeros(len(anchor))
            last[up], last[down] = self.values[n - depth, up], self.values[depth - 1, down]
            threshold = None if depth == n else sum(int(x) * int(y) for x, y in zip(last, anchor))
            yield at, self.score(at, anchor), threshold
            begin, depth = depth, min(2 * depth, n)
        if not len(up) + len(down):
            yield np.arange(n), np.zeros(n, dtype=np.int64), None


class Best:
    """The first ``k`` of what it is given, by score descending and id, with the row of each."""

    def __init__(self, k: int):
        self.k, self.found = k, []

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(self.found) == self.k and len(scores):
            near = scores >= self.found[-1][0] * -1
            scores, ids, rows = scores[near], ids[near], rows[near]
        if len(scores) > 4 * self.k and scores.dtype != object:
            near = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids, rows = scores[near], ids[near], rows[near]
        self.found = sorted([*self.found, *((-int(s), int(i), int(r)) for s, i, r in zip(scores, ids, rows))])[: self.k]

    def done(self, threshold: int) -> bool:
        return len(self.found) == self.k and threshold < -self.found[-1][0]


def positives_of(shard: Shard, row: int, anchor: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(score, id, row) of the first ``k`` rows of a shard, without the anchor's own row."""
    best = Best(k)
    for at, scores, threshold in shard.read(anchor):
        own = shard.rows[at] != row
        best.add(scores[own], shard.ids[at][own], shard.rows[at][own])
        if threshold is not None and best.done(threshold):
            break
    return [(-s, i, r) for s, i, r in best.found]


def negatives_of(shard: Shard, anchor: np.ndarray, bars: list[int], k: int, low: int, high: int) -> list[tuple[int, int, int, int]]:
    """(bar, score, id, row): for each positive's score the first ``k`` rows of a shard that lie in its window."""
    windows = {bar: Best(k) for bar in set(bars) if low * bar <= high * bar}
    for at, scores, threshold in shard.read(anchor) if windows else ():
        for bar, best in windows.items():
            inside = (scores * 100 >= low * bar) & (scores * 100 <= high * bar)
            best.add(scores[inside], shard.ids[at][inside], shard.rows[at][inside])
        if threshold is not None and all(best.done(threshold) or 100 * threshold < low * bar for bar, best in windows.items()):
            break
    return [(bar, -s, i, r) for bar, best in windows.items() for s, i, r in best.found]


def candidates(embeddings: DataFrame, vector: str, label: Column) -> DataFrame:
    """row, vec_id, label, vector (whole numbers as doubles, little-endian bytes) of the rows that take part, each once."""
    rows = require(embeddings, "vec_id", "label", vector).withColumnRenamed(vector, "x")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("x").cast("array<double>").alias("x")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            flat, ends = np.floor(256 * x.flatten().to_numpy(zero_copy_only=False)) + 0.0, np.cumsum([0, *x.value_lengths().to_pylist()])
            packed = [flat[a:b].astype("<f8").tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(packed, pa.binary())], names=["vec_id", "label", "vector"])

    found = rows.mapInArrow(run, "vec_id long, label long, vector binary")
    return stored(found.withColumn("row", F.monotonically_increasing_id()))


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x = np.frombuffer(v, dtype="<f8")
        out[i, : len(x)] = x
    return out


def _meet(shards: DataFrame, asked: DataFrame, search, schema: str) -> DataFrame:
    """``search(shard, row, anchor, bars)`` for every anchor of a block that meets a shard; ``asked`` names both."""

    def run(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            vectors, sought = rows.column("vector").to_pylist(), anchors.column("a_vector").to_pylist()
            width = max(len(v) for v in [*vectors, *sought]) // 8
            shard = Shard(rows.column("row").to_numpy(), rows.column("vec_id").to_numpy(), _matrix(vectors, width))
            bars = anchors.column("a_bars").to_pylist()
            for row, anchor, own in zip(anchors.column("a_row").to_pylist(), _matrix(sought, width), bars):
                out += [(row, *found) for found in search(shard, row, anchor, own)]
        columns = list(zip(*out)) or [()] * len(names)
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    asked = asked.select(*[F.col(c).alias(f"a_{c}") for c in asked.columns])  # both sides come from the same table
    return shards.groupBy("shard", "block").cogroup(asked.groupBy("a_shard", "a_block")).applyInArrow(run, schema)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "found")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(embeddings: DataFrame, vector: str = "embedding", anchors: Column | None = None, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``anchors`` is a condition on vec_id and
    label (every row, if not given), ``label`` the label in use. The window is ``low`` to ``high`` hundredths of the positive's score."""
    rows = candidates(embeddings, vector, F.col("label") if label is None else label)
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / shard).alias("shards"))
    before = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    numbered = sizes.select(F.col("label").alias("l"), "shards", F.coalesce(F.sum("shards").over(before), F.lit(0)).alias("first"), F.sum("shards").over(Window.partitionBy()).alias("total"))
    placed = rows.join(numbered, F.col("label") == F.col("l")).drop("l")
    own = F.lit(True) if anchors is None else anchors
    n_anchors = rows.filter(own).count()
    blocks = max(1, -(-n_anchors // block))
    dealt = placed.withColumn("shard", F.col("first") + F.pmod(F.xxhash64("row"), "shards")).select("shard", "row", "vec_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    sought = placed.filter(own).withColumn("block", F.pmod(F.hash("row"), F.lit(blocks)).cast("int"))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>"))
    first, last = F.col("first"), F.col("first") + F.col("shards") - 1

    asked = sought.select("row", "vector", "block", F.array().cast("array<long>").alias("bars"), F.explode(span(first, last)).alias("shard"))
    near = _meet(dealt, asked, lambda s, row, anchor, _: positives_of(s, row, anchor, positives), "row long, score long, id long, found long")
    near = stored(_first(near, ["row"], positives))

    bars = near.groupBy("row").agg(F.collect_set("score").alias("bars"))  # at most ``positives`` each
    others = F.concat(span(F.lit(0).cast("long"), first - 1), span(last + 1, F.col("total") - 1))
    asked = sought.join(bars, "row").select("row", "vector", "block", "bars", F.explode(others).alias("shard"))
    hard = _meet(dealt, asked, lambda s, _, anchor, own: negatives_of(s, anchor, own, negatives, low, high), "row long, bar long, score long, id long, found long")
    hard = _first(hard, ["row", "bar"], negatives).select("row", F.col("bar").alias("score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("row", "score", F.col("id").alias("positive_id"))
    out = near.join(hard, ["row", "score"]).join(sought.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score")
