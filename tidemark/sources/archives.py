"""Tables in tar archives, as the bulk release of hit tables is published: a member per table, the table's name the member's.

A file per table costs a path in the driver, an entry in each listing and two or three calls to the file system, whatever it
holds; an archive costs them once for all its tables. Archives are written by many tasks. To read them, each one's headers give
name, place and length of its tables, without their text; tables that are wanted are then cut into ranges, which are dealt out,
so neither many small tables nor a large one are a single task's share. Compressed archives can't be read from within.
"""

from __future__ import annotations

import tarfile
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.members import open_uri

#: Bytes after which another archive is begun; bytes of a table that a writing task holds in memory, the rest in a temporary file.
ARCHIVE, HELD = 64 << 20, 16 << 20
#: Bytes of a table that are read at once, and of an archive that are dealt out together.
RANGE, SHARE = 1 << 20, 8 << 20


def write_tables(rows: DataFrame, key: str, value: Column, folder: str, name: str, header: str = "") -> None:
    """A table of ``rows`` for each key, with the lines ``value`` and the name that ``name`` makes of it ("table-{}.txt").

    Names are given once an archive is whole. A repeated attempt of a task writes whole archives of its own, whose tables have the
    names that they had before: readers take one table of each name."""
    most, held_in_memory, top, folder = ARCHIVE, HELD, header.encode(), folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_uri(folder)
        fs.create_dir(base, recursive=True)
        at, held, tar, stream, file, tables, done = None, None, None, None, "", 0, []

        def close() -> None:
            nonlocal tar, tables
            tar.close()
            stream.close()
            fs.move(f"{base}/_{file}", f"{base}/{file}")
            done.append((file, tables))
            tar, tables = None, 0

        def put() -> None:
            nonlocal tar, stream, file, tables
            if tar is None:
                file = f"{uuid.uuid4().hex}.tar"
                stream = fs.open_output_stream(f"{base}/_{file}", compression=None)
                tar = tarfile.open(fileobj=stream, mode="w|")
            info = tarfile.TarInfo(name.format(at))
            info.size = held.tell()
            held.seek(0)
            tar.addfile(info, held)
            held.close()
            tables += 1
            if tar.offset >= most:
                close()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, values = batch.column("key"), pc.fill_null(batch.column("value"), "")
            starts = [0, *(i + 1 for i, x in enumerate(pc.not_equal(keys[1:], keys[:-1]).to_pylist()) if x)]
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([*starts, len(keys)], pa.int32()), values), "\n").cast(pa.binary())
            for k, text in zip(keys.take(pa.array(starts)).to_pylist(), lines.to_pylist()):
                if k != at:
                    if at is not None:
                        put()
                    at, held = k, tempfile.SpooledTemporaryFile(held_in_memory)
                    held.write(top)
                held.write(text + b"\n")
        if at is not None:
            put()
        if tar is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["file", "tables"])

    together = rows.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key)  # as narrow as the rows come
    lines = together.select(F.col(key).cast("string").alias("key"), value.alias("value"))
    lines.mapInArrow(run, "file string, tables long").write.format("noop").mode("overwrite").save()


def tables(spark: SparkSession, folder: str) -> DataFrame:
    """file, name, offset and length of every table in the archives (*.tar) of a folder, from their headers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, file = open_uri(path)
                found = []
                with fs.open_input_file(file) as stream, tarfile.open(fileobj=stream, mode="r:") as tar:
                    while (m := tar.next()) is not None:
                        tar.members = []  # it would keep them all
                        if m.isreg():
                            found.append((path, m.name, m.offset_data, m.size))
                columns, kinds = list(zip(*found)) or [()] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "name", "offset", "length"])

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(folder).select("path")
    return listed.mapInArrow(run, "file string, name string, offset long, length long")


def read_lines(chosen: DataFrame, key: str) -> DataFrame:
    """The lines (``line``, those without text left out) of ``chosen`` tables (file, offset, length), each with its ``key``, a long.

    A line belongs to the range that it begins in, and is read to its end."""
    size = RANGE

    def text_of(stream, offset: int, length: int, begin: int) -> bytes:
        def read(n: int) -> bytes:
            if len(data := stream.read(n)) != n:
                raise OSError("an archive ends within a table")
            return data

        before, end = min(begin, 1), min(begin + size, length)  # the byte before tells whether a line begins here
        stream.seek(offset + begin - before)
        data = read(end - begin + before)
        if before:
            first = data.find(b"\n")
            data = data[first + 1 :] if first >= 0 else b""
        if not data or data.endswith(b"\n"):
            return data
        parts = [data]
        while end < length:
            more = read(min(1 << 16, length - end))
            end, last = end + len(more), more.find(b"\n")
            parts.append(more if last < 0 else more[:last])
            if last >= 0:
                break
        return b"".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stream = None, None
        for batch in batches:
            keys, texts, held = [], [], 0
            for k, file, offset, length, begin in zip(*[batch.column(c).to_pylist() for c in ("key", "file", "offset", "length", "begin")]):
                if file != at:
                    if stream is not None:
                        stream.close()
                    fs, name = open_uri(file)
                    at, stream = file, fs.open_input_file(name)
                texts.append(text_of(stream, offset, length, begin).decode("utf-8", "replace"))
                keys.append(k)
                held += len(texts[-1])
                if held >= size:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string())], names=["key", "text"])
                    keys, texts, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string())], names=["key", "text"])
        if stream is not None:
            stream.close()

    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    ranges = chosen.filter("length > 0").select(F.col(key).alias("key"), "file", "offset", "length", begins.alias("begin"))
    share = F.floor((F.col("offset") + F.col("begin")) / SHARE)
    tasks = int(chosen.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows that stand for much work: a number given isn't merged
    texts = ranges.repartition(tasks, "file", share).sortWithinPartitions("file", "offset", "begin").mapInArrow(run, "key long, text string")
    return texts.select(F.col("key").alias(key), F.explode(F.split("text", "[\r\n]+")).alias("line")).filter(F.trim("line") != "")
