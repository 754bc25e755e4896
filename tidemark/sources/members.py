"""Large files read in pieces: digests of files that no task holds (S03), and gzip files that many tasks read.

A gzip file may be a row of members, each compressed on its own; every reader of gzip takes them for one stream. Written so, with
an index of where each member begins, a file can be read from any of its members on:

    folder/*.jsonl.gz    lines in gzip members, a file per writing task
    folder/_index        Parquet: file, offset, length, lines

The index says which files count: those of a repeated or speculative attempt aren't on it, and are removed after it is written.
Another ``write_lines`` to the same folder replaces the index in one commit of Spark's, and then removes the files before it.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files up to this many bytes are hashed by Spark's own reader, larger ones in chunks.
WHOLE, CHUNK = 64 << 20, 8 << 20
#: Characters of lines in a member, unless one line alone is longer.
MEMBER = 4 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def _dealt(table: DataFrame, *by: str) -> DataFrame:
    """Few rows that stand for much work: over all shuffle partitions, which a number given keeps from being merged."""
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and sha256 of every file below ``folder``. Files over ``WHOLE`` bytes are never a value of a row: one task
    each streams them through the digest, ``CHUNK`` bytes at a time; the listing opens none. Spark's readers skip empty files:
    see ``empty_files``."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    small = listed.filter(F.col("length") <= WHOLE).select("path", "length", F.sha2("content", 256).alias("sha256"))
    chunk = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                fs, name = open_uri(path)
                digest, seen = hashlib.sha256(), 0
                with fs.open_input_stream(name, compression=None) as stream:
                    while data := stream.read(chunk):
                        digest.update(data)
                        seen += len(data)
                if seen != length:
                    raise OSError(f"{path} had {length} bytes when it was listed, {seen} when it was read")
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(found, pa.string())], names=["path", "length", "sha256"])

    large = _dealt(listed.filter(F.col("length") > WHOLE).select("path", "length"), "path")
    return small.unionByName(large.mapInArrow(run, "path string, length long, sha256 string"))


def empty_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and sha256 of the empty files below ``folder``, from a listing by the driver, which keeps their names alone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found, listed = [], path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    while listed.hasNext():
        status = listed.next()
        if status.getLen() == 0:
            found.append((status.getPath().toString(), 0, EMPTY))
    return spark.createDataFrame(found, "path string, length long, sha256 string")


def write_lines(lines: DataFrame, folder: str) -> DataFrame:
    """Write the column ``value`` of ``lines`` (strings without line breaks; nulls are left out) and give the index."""
    member, spark, folder = MEMBER, lines.sparkSession, folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_uri(folder)
        fs.create_dir(base, recursive=True)
        name, places, at = uuid.uuid4().hex, [], 0
        held, size, stream = [], 0, None

        def put() -> None:
            nonlocal at, size, stream
            stream = stream or fs.open_output_stream(f"{base}/_{name}", compression=None)
            data = gzip.compress(("\n".join(held) + "\n").encode(), 6, mtime=0)
            stream.write(data)
            places.append((f"{name}.jsonl.gz", at, len(data), len(held)))
            at, size = at + len(data), 0
            held.clear()

        for batch in batches:
            for line in batch.column("value").to_pylist():
                if line is None:
                    continue
                held.append(line)
                size += len(line) + 1
                if size >= member:
                    put()
        if held:
            put()
        if stream is not None:
            stream.close()
            fs.move(f"{base}/_{name}", f"{base}/{name}.jsonl.gz")
        columns = list(zip(*places)) or [()] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "offset", "length", "lines"])

    index = lines.select("value").mapInArrow(run, "file string, offset long, length long, lines long")
    index.write.mode("overwrite").parquet(f"{folder}/_index")
    _sweep(spark, folder)
    return spark.read.parquet(f"{folder}/_index")


def _sweep(spark: SparkSession, folder: str) -> None:
    """Remove files that aren't on the index; their number is that of the writing tasks."""
    kept = {r["file"] for r in spark.read.parquet(f"{folder}/_index").select("file").distinct().collect()} | {"_index"}
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(path):
        if status.getPath().getName() not in kept:
            files.delete(status.getPath(), True)


def has_index(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_index/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines (value) of a folder that ``write_lines`` wrote. Members are dealt out by their places, so one large file is read
    by many tasks, each of which holds one member at a time; the lines come in no order."""
    folder = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, offset, length, n in zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length", "lines")]):
                fs, name = open_uri(f"{folder}/{file}")
                with fs.open_input_file(name) as stream:
                    stream.seek(offset)
                    lines = gzip.decompress(stream.read(length)).decode().split("\n")[:-1]
                if len(lines) != n:
                    raise ValueError(f"{file} holds {len(lines)} lines at {offset}, its index says {n}")
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    return _dealt(spark.read.parquet(f"{folder}/_index"), "file", "offset").mapInArrow(run, "value string")
