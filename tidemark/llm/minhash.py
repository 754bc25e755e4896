"""One-permutation MinHash fingerprints with optimal densification and b-bit packing.

A text's distinct five-word shingles are hashed once; the upper bits of a hash choose a bin and the smallest hash of each
bin stays. An empty bin takes the value of a bin that a fixed random walk of its own meets first (the same walk for every
text). Of each bin only the lowest ``BITS`` bits are stored, packed into a hex string; since unlike bins agree in them by
chance, ``likeness`` corrects for that.

Texts with fewer words than a shingle are one shingle; texts without words have the empty fingerprint, alike only to
itself. Null texts count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import require
from tidemark.llm.simhash import remix, shingle_hashes

WORDS, BINS, BITS, SEED = 5, 512, 4, 7
#: Steps of a bin's walk; a bin that meets none then takes its next full neighbour to the right.
STEPS = 4096

_walks: dict[int, np.ndarray] = {}


def walk(bins: int = BINS) -> np.ndarray:
    """For each bin, which bins it asks in turn."""
    if bins not in _walks:
        at = np.arange(bins * STEPS, dtype=np.uint64)
        _walks[bins] = (remix(at, 1) % np.uint64(bins)).astype(np.int32).reshape(bins, STEPS)
    return _walks[bins]


def sketch(text: bytes, words: int = WORDS, bins: int = BINS) -> np.ndarray | None:
    """The densified bin values of a text, or None for a text without words. ``bins`` is a power of two."""
    h = np.unique(shingle_hashes(text, words, SEED))
    if not len(h):
        return None
    place = (h >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    full, first = np.unique(place, return_index=True)  # sorted hashes: the first of a bin is its smallest
    values = np.zeros(bins, dtype=np.uint64)
    values[full] = h[first]
    if len(full) < bins:
        has = np.zeros(bins, dtype=bool)
        has[full] = True
        empty, paths, source = np.flatnonzero(~has), walk(bins), np.full(bins, -1, dtype=np.int64)
        for step in range(0, STEPS, 64):
            asked = paths[empty, step : step + 64]
            hit = has[asked]
            met = hit.any(axis=1)
            source[empty[met]] = asked[met, hit[met].argmax(axis=1)]
            empty = empty[~met]
            if not len(empty):
                break
        if len(empty):
            source[empty] = full[np.searchsorted(full, empty) % len(full)]
        filled = np.flatnonzero(source >= 0)
        values[filled] = values[source[filled]]
    return values


def packed(values: np.ndarray | None, bits: int = BITS) -> bytes:
    """The low ``bits`` bits (1, 2, 4 or 8) of every bin."""
    if values is None:
        return b""
    low = (remix(values, 2) & np.uint64(2**bits - 1)).astype(np.uint8)
    rows = low.reshape(-1, 8 // bits)
    return np.bitwise_or.reduce(rows << (np.arange(8 // bits, dtype=np.uint8) * bits), axis=1).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """The estimated Jaccard similarity of two packed fingerprints, corrected for chance agreement, in [0, 1]."""
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(a, dtype=np.uint8) ^ np.frombuffer(b, dtype=np.uint8)
    same = sum(int(((x >> np.uint8(k)) & np.uint8(2**bits - 1) == 0).sum()) for k in range(0, 8, bits)) / (len(a) * 8 // bits)
    chance = 2.0**-bits
    return max(0.0, (same - chance) / (1 - chance))


def fingerprint(text: bytes) -> bytes:
    return packed(sketch(text))


def fingerprints(documents: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, fingerprint) of every whole text."""
    rows = require(documents, id_column, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint((x or "").encode()).hex() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(prints, pa.string())], names=["id", "fingerprint"])

    return rows.mapInArrow(run, f"id {rows.schema[id_column].dataType.simpleString()}, fingerprint string")


def _bucket(key: Column, cuts: list) -> Column:
    """How many of the sorted cuts are at or below the key, as a tree of comparisons; null keys come first."""

    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key.isNull() | (key < F.lit(cuts[middle])), part(low, middle)).otherwise(part(middle + 1, high))

    return part(0, len(cuts))


def with_next(documents: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows (doc_id, text, bucket, extra) sorted by doc_id in their partitions, one bucket of ids in each.

    After a bucket's own rows stands, marked extra, the first row of the next bucket (of the first one behind the last),
    so that every own row has its successor right behind it. Texts are shuffled once; ids must be numbers; nulls come
    first; rows with equal ids are in the order of their texts.
    """
    rows = require(documents, "doc_id", "text")
    spark = documents.sparkSession
    partitions = min(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), 4096)
    cuts = sorted(set(rows.select(F.col("doc_id").cast("double").alias("d")).stat.approxQuantile("d", [i / partitions for i in range(1, partitions)], 0.1 / partitions))) if partitions > 1 else []
    bucket = _bucket(F.col("doc_id"), cuts)
    heads = rows.groupBy(bucket.alias("bucket")).agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("head")).orderBy("bucket").collect()  # one per partition
    to = {r["bucket"]: heads[i - 1]["bucket"] for i, r in enumerate(heads)}
    buckets = [F.struct(F.col("bucket"), F.lit(False).alias("extra"))]
    extra = F.lit(None).cast("int")
    for r in heads:
        extra = F.when((F.col("bucket") == r["bucket"]) & F.col("doc_id").eqNullSafe(F.lit(r["head"])), F.lit(to[r["bucket"]])).otherwise(extra)
    if len(heads) > 64:  # a long chain of tests is dear: look the heads up instead
        table = spark.createDataFrame([(r["bucket"], r["head"], to[r["bucket"]]) for r in heads], f"h_bucket int, head {rows.schema['doc_id'].dataType.simpleString()}, h_to int")
        marked = rows.withColumn("bucket", bucket).join(F.broadcast(table), (F.col("bucket") == F.col("h_bucket")) & F.col("doc_id").eqNullSafe(F.col("head")), "left").withColumn("extra_to", F.col("h_to"))
    else:
        marked = rows.withColumn("bucket", bucket).withColumn("extra_to", extra)
    copies = F.array_append(F.array(*buckets), F.struct(F.col("extra_to").alias("bucket"), F.lit(True).alias("extra")))
    dealt = marked.withColumn("copy", F.explode(F.when(F.col("extra_to").isNull(), F.array(*buckets)).otherwise(copies)))
    dealt = dealt.select("doc_id", "text", "copy.bucket", "copy.extra")
    return dealt.repartitionById(partitions, F.col("bucket")).sortWithinPartitions("bucket", "extra", F.col("doc_id").asc_nulls_first(), "text")


def compare_edits(documents: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edit, whose last half is replaced by the beginning of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. With one row, the next
    document is the row itself.
    """
    rows = with_next(documents, partitions)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # (doc_id, text, fingerprint, bucket) that waits for its successor
        for batch in batches:
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            out: list[tuple] = []
            done: dict[str, bytes] = {}
            for key, text, bucket, extra in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "extra")]):
                if extra and (last is None or last[3] != bucket):
                    continue  # a further row with the id of the first one
                text = text or ""
                own = done.get(text)
                if own is None:
                    own = done[text] = fingerprint(text.encode())
                if last is not None:
                    half = len(last[1]) // 2
                    edited = (last[1][: len(last[1]) - half] + text[:half]).encode()
                    print_ = last[2] if edited == last[1].encode() else fingerprint(edited)
                    out.append((last[0], len(last[1]), hashlib.sha256(edited).hexdigest(), last[2].hex(), print_.hex(), likeness(last[2], print_), likeness(last[2], own)))
                last = None if extra else (key, text, own, bucket)
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
