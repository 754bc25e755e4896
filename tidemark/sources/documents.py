"""Large JSON documents read by many tasks: one row per element of the array, or per entry of the object, at the top.

Spark splits a document into byte ranges at commas. Inside a string a comma means nothing, and a range can't know whether it
starts inside one, nor how deep. So every range is first scanned under both hypotheses, which gives two possible end states
and changes of depth; composing these in the order of the ranges (a few numbers each) tells where each range really starts.
Then every range cuts its own text at the commas of depth 1. What stays open at its ends is joined across ranges.

Documents that Spark would not split need none of this: they are read whole and cut in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.folders import scratch_folder

#: Documents up to this many bytes (or up to a split, if that is smaller) are read whole, by one task each.
WHOLE = 16 << 20
_COMPRESSED = r"(?i)\.(gz|gzip|bz2|deflate|lz4|snappy|zst|zstd|xz)$"
_ESCAPE = re.compile(rb"\\.", re.DOTALL)
#: What each byte means: how it changes the depth, and whether it counts at all.
_CHANGE, _COUNTS = np.zeros(256, np.int64), np.zeros(256, bool)
_CHANGE[list(b"[{")], _CHANGE[list(b"]}")], _COUNTS[list(b'[{]},"')] = 1, -1, True


def marks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where quotes, commas and brackets stand that no backslash escapes; their bytes; whether the quotes up to each are odd."""
    codes = np.frombuffer(_ESCAPE.sub(b"__", text) if b"\\" in text else text, np.uint8)
    at = np.flatnonzero(_COUNTS[codes])
    found = codes[at]
    return at, found, np.cumsum(found == ord('"')) % 2 == 1


def _ranges(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple[tuple, bytes, tuple]]:
    """The runs of lines of one range in a batch, as their text with a comma behind each, and the range's ``more`` columns."""
    for batch in batches:
        files, blocks = batch.column("file"), batch.column("block").to_numpy(zero_copy_only=False)
        differs = (blocks[1:] != blocks[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(differs) + 1).tolist(), len(blocks)] if len(blocks) else [0]
        for first, end in zip(starts, starts[1:]):  # Python sees a file's name once per run, not once per comma
            text = ",".join(batch.column("value")[first:end].to_pylist()) + ","
            yield (files[first].as_py(), int(blocks[first])), text.encode(), tuple(batch.column(c)[first].as_py() for c in more)


def effects_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, odd_before, depths, out = None, False, [0, 0], []

    def done() -> None:
        if at is not None:
            out.append((*at, odd_before, depths[0], not odd_before, depths[1]))

    for key, text, _ in _ranges(batches):
        if key != at:
            done()
            at, odd_before, depths = key, False, [0, 0]
        _, found, odd = marks(text)
        change, odd = _CHANGE[found], odd ^ odd_before
        depths = [depths[0] + int(change[~odd].sum()), depths[1] + int(change[odd].sum())]
        odd_before = bool(odd[-1]) if len(odd) else odd_before
    done()
    columns = list(zip(*out)) or [()] * 6
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "block", "open0", "depth0", "open1", "depth1"])


def range_effects(lines: DataFrame) -> DataFrame:
    """file, block, and for a start outside (0) and inside (1) a string: whether one is open at the end, and the change of depth."""
    return lines.mapInArrow(effects_of, "file string, block long, open0 boolean, depth0 long, open1 boolean, depth1 long")


def start_states(effects: DataFrame) -> DataFrame:
    """file, block, in_string, depth at the start of every range: the effects composed, a row per range of a file."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame, states, in_string, depth = frame.sort_values("block"), [], False, 0
        for r in frame.itertuples():
            states.append((r.file, r.block, in_string, depth))
            in_string, depth = (r.open1, depth + r.depth1) if in_string else (r.open0, depth + r.depth0)
        return pd.DataFrame(states, columns=["file", "block", "in_string", "depth"])

    return effects.groupBy("file").applyInPandas(run, "file string, block long, in_string boolean, depth long")


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("k", pa.int64()), ("begins", pa.bool_()), ("ends", pa.bool_()), ("text", pa.string())])
    at, in_string, depth, k, begins, held, out = None, False, 0, -1, False, [], []

    def put(ends: bool, last: bytes = b"") -> None:
        text = b"".join((*held, last))
        if ends or text:  # what is open has a comma too many
            out.append((*at, k, begins, ends, (text if ends else text[:-1]).decode()))

    def rows() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * 6, schema)], schema=schema)
        out.clear()
        return found

    for key, text, (string, level) in _ranges(batches, "in_string", "depth"):
        if key != at:
            put(False)
            at, in_string, depth, k, begins, held = key, string, level, -1, False, []
            if level == 1 and not string and key[1]:  # the range starts behind a comma of depth 1
                k, begins = 0, True
        where, found, odd = marks(text)
        odd ^= in_string
        change = np.where(odd, 0, _CHANGE[found])
        after, start = depth + np.cumsum(change), 0
        events = np.flatnonzero(~odd & (((found == ord(",")) | (change == 1)) & (after == 1) | (change == -1) & (after == 0)))
        for step, place in zip(change[events].tolist(), where[events].tolist()):
            if step == 1:  # a document's first bracket
                k, begins = 0, True
            else:
                last = text[start:place]
                if step == 0 or not begins or held or last.strip():  # not an empty document
                    put(True, last)
                k, begins = (k + 1, True) if step == 0 else (k, False)
            held, start = [], place + 1
        in_string, depth = (bool(odd[-1]), int(after[-1])) if len(odd) else (in_string, depth)
        if depth:
            held.append(text[start:])
        if len(out) > 1000:
            yield rows()
    put(False)
    yield rows()


def cut(lines: DataFrame, states: DataFrame) -> DataFrame:
    """Parts of elements: file, block, k (the place among those that start in the range, -1 for one that doesn't), begins,
    ends, text. Most begin and end; only a range's first and last can be parts."""
    known = lines.join(F.broadcast(states), ["file", "block"])  # a row per range, not per byte
    return known.select("file", "block", "value", "in_string", "depth").mapInArrow(parts_of, "file string, block long, k long, begins boolean, ends boolean, text string")


def elements_of(text: bytes) -> list[str]:
    """The elements of a whole document."""
    where, found, odd = marks(text)
    change = np.where(odd, 0, _CHANGE[found])
    after, start, out, opened = np.cumsum(change), 0, [], False
    events = np.flatnonzero(~odd & (((found == ord(",")) | (change == 1)) & (after == 1) | (change == -1) & (after == 0)))
    for step, place in zip(change[events].tolist(), where[events].tolist()):
        if step == 0 or step == -1 and (not opened or text[start:place].strip()):  # not an empty document
            out.append(text[start:place].decode())
        opened, start = step == 1, place + 1
    return out


def whole_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, value in zip(batch.column("file"), batch.column("value")):
            texts = elements_of(value.as_buffer().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(texts), pa.string()), pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["file", "position", "text"])


def read_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, position (from 0) and text of every element of the documents' top array or object (``"key": value``).

    A document that isn't JSON gives wrong elements, no error. Compressed files can't be split and are read by one task each.
    """
    most = min(WHOLE, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    file, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    small = (size <= most) & ~file.rlike(_COMPRESSED)  # told from the listing: files of the other kind aren't opened
    read = spark.read.text(path, wholetext=True).filter(small).select(file.alias("file"), "value")
    whole = read.mapInArrow(whole_elements, "file string, position long, text string")
    lines = spark.read.option("lineSep", ",").text(path).filter(~small).select(file.alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return whole if lines.isEmpty() else whole.unionByName(range_elements(lines))


def range_elements(lines: DataFrame) -> DataFrame:
    """The elements of documents given as ``lines`` (file, block, value: what stands between two commas), in ranges."""
    spark = lines.sparkSession
    states = start_states(range_effects(lines))
    folder = scratch_folder(spark, "elements")
    states.write.parquet(f"{folder}/states")
    cut(lines, spark.read.parquet(f"{folder}/states")).write.parquet(f"{folder}/parts")
    parts = spark.read.parquet(f"{folder}/parts")
    counts = parts.filter("begins").groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    whole = parts.filter("begins AND ends").select("file", "block", "k", "text")
    upto = Window.partitionBy("file").orderBy("block", "k").rowsBetween(Window.unboundedPreceding, 0)
    open_ = parts.filter("NOT (begins AND ends)").withColumn("element", F.sum(F.col("begins").cast("long")).over(upto))  # two a range at most
    pieces = F.array_sort(F.collect_list(F.struct("block", "k", "text")))
    joined = open_.groupBy("file", "element").agg(pieces.alias("p")).select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["k"].alias("k"), F.array_join("p.text", ",").alias("text"))
    found = whole.unionByName(joined).join(starts, ["file", "block"])
    return found.select("file", (F.col("start") + F.col("k")).alias("position"), "text")
