"""Packing tokenised documents into sequences, best fit first, in bulk-synchronous rounds.

``cut`` encodes documents and cuts those over the capacity into full pieces, the first of which may be shorter.
``pack`` places pieces. They are range-sorted by length and ranked within it, over the whole cluster. Lengths are whole
numbers up to the capacity, so the pieces are at most ``capacity`` runs of equal length, and gaps are at most three times
as many runs of sequences with equal space: that bounds what the rounds work on, whatever the input's size, and one job
takes all of them. A round
  1. takes the longest run of pieces that is left and the gaps, sorted by space;
  2. sweeps for successors: the pieces' place is the smallest gap of at least their length, then the next one;
  3. settles conflicts by rank: a run of gaps takes as many pieces as it holds, in their order, and the rest moves on to
     the next gap; where no gap is left, sequences are opened;
  4. updates the gaps, for the next round to start from.
Every piece then finds its sequence and offset by its length and rank, in parallel. The number of sequences is that of
best fit decreasing, one piece after the other: pieces of one length fill the smallest gap that holds them until they
don't fit any more, which is what a round does.

Null texts count as empty (one end token). Repeated rows and equal lengths are ranked by doc_id and piece; which of two
equal rows comes first has no effect on the number of sequences. Empty tables give an empty result. Other columns may have
any names but sequence_id and offset, which are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, fresh, require, stored
from tidemark.llm.tokens import _bytes, encode_all

CAPACITY, END = 2048, 0


def cut(documents: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids (little-endian, 32 bits) if wanted."""
    end = np.asarray([END], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for key, ids in zip(keys, encode_all(_bytes(batch.column("text")), path)):
                ids += end
                n = len(ids) // 4
                begins = [0, *range(n % capacity or capacity, n, capacity)]
                for piece, (a, b) in enumerate(zip(begins, [*begins[1:], n])):
                    part = ids[4 * a : 4 * b]
                    rows.append((key, piece, a, b - a, zlib.crc32(part), part if with_ids else None))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    rows = require(documents, "doc_id", "text")
    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


STEPS = "length long, rank long, count long, each long, first long, offset long"


class Gaps:
    """Runs of sequences with equal space: by space, the first sequence's number and how many follow it."""

    def __init__(self, capacity: int):
        self.capacity, self.opened = capacity, 0
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, space: int, first: int, n: int) -> None:
        if n:
            self.runs[space].append((first, n))

    def round(self, length: int, pieces: int) -> Iterator[tuple[int, ...]]:
        """Place ``pieces`` of a length: rows of STEPS. ``count`` pieces from ``rank`` on go, ``each`` per sequence and
        side by side from ``offset`` on, to the sequences from ``first`` on."""
        rank = 0
        for space in range(length, self.capacity + 1):
            while self.runs[space] and rank < pieces:
                for step in self.fill(space, *self.runs[space].pop(), length, rank, pieces - rank):
                    rank += step[2]
                    yield step
            if rank == pieces:
                return
        n = -(-(pieces - rank) // (self.capacity // length))
        self.opened += n
        yield from self.fill(self.capacity, self.opened - n, n, length, rank, pieces - rank)

    def fill(self, space: int, first: int, n: int, length: int, rank: int, wanted: int) -> Iterator[tuple[int, ...]]:
        holds = space // length
        whole, rest = divmod(min(wanted, n * holds), holds)
        offset = self.capacity - space
        if whole:
            yield length, rank, whole * holds, holds, first, offset
            self.put(space - holds * length, first, whole)
        if rest:
            yield length, rank + whole * holds, rest, rest, first + whole, offset
            self.put(space - rest * length, first + whole, 1)
        used = whole + (rest > 0)
        self.put(space, first + used, n - used)


def rounds(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All rounds over ``lengths`` (length, n; a row per length), longest first. Gives the steps: length, rank, count, each,
    first, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict(r for b in batches for r in zip(b.column("length").to_pylist(), b.column("n").to_pylist()))
        if counts and not 1 <= min(counts) <= max(counts) <= capacity:
            raise ValueError("a piece's length must lie between 1 and the capacity")
        gaps = Gaps(capacity)
        for length in sorted(counts, reverse=True):
            columns = list(zip(*gaps.round(length, counts[length])))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in STEPS.split(", ")])

    # at most ``capacity`` rows, which one task takes; they are counted before that, by many
    counted = stored(lengths.select(F.col("length").cast("long").alias("length"), F.col("n").cast("long").alias("n")).filter("n > 0"))
    return counted.coalesce(1).mapInArrow(run, STEPS)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns; doc_id, piece and length are used) with sequence_id and offset."""
    pieces = stored(pieces.drop("sequence_id", "offset"))  # range-sorting reads them twice
    part, place, rank = (fresh(pieces, name) for name in ("part", "place", "rank"))
    ranged = durable(pieces.repartitionByRange("length", "doc_id", "piece").withColumn(part, F.spark_partition_id()))
    sums = stored(ranged.groupBy(F.col(part).alias("p"), F.col("length").cast("long").alias("l")).agg(F.count("*").alias("n")))
    steps = rounds(sums.groupBy(F.col("l").alias("length")).agg(F.sum("n").alias("n")), capacity)
    before = Window.partitionBy("l").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select(F.col("p").alias(fresh(ranged, "at_part")), F.col("l").alias(fresh(ranged, "at_length")), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(fresh(ranged, "begin")))
    at_part, at_length, begin = begins.columns
    numbered = ranged.withColumn(place, F.row_number().over(Window.partitionBy(part, "length").orderBy("doc_id", "piece")) - 1)
    ranked = numbered.join(begins, (F.col(f"`{part}`") == F.col(at_part)) & (F.col("length") == F.col(at_length))).withColumn(rank, F.col(f"`{place}`") + F.col(begin))
    names = ["length", "rank", "each", "first", "offset"]
    found = np.array(sorted(tuple(r[k] for k in names) for r in steps.collect()), dtype=np.int64).reshape(-1, 5)
    plan = pieces.sparkSession.sparkContext.broadcast(found)  # bounded by the capacity alone

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, start, each, first, offset = plan.value.T
        for b in batches:
            n, r = b["length"].to_numpy(np.int64), b[rank].to_numpy(np.int64)
            at = np.searchsorted((length << 48) + start, (n << 48) + r, side="right") - 1
            i = r - start[at]
            yield b.drop(columns=rank).assign(sequence_id=first[at] + i // each[at], offset=offset[at] + i % each[at] * n)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*[f"`{c}`" for c in pieces.columns], f"`{rank}`").mapInPandas(run, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves from pieces that carry ids: sequence_id, n_tokens, doc_ids, ids (binary)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    out = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return out.select("sequence_id", "n_tokens", F.col("parts.doc_id").alias("doc_ids"), joined.alias("ids"))
