"""WARC records in ZIP packages: writing them, and reading them by ranges without extraction.

A package is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz``, each record a gzip member of its
own, and ``indexes/index.cdxj``, a line per record with its place. ``members`` parses a package's end record and central
directory (and their ZIP64 forms) from its tail; ``split_packages`` lists the record ranges of the index; ``read_records``
reads those ranges, spread over the cluster, from inside the package.

Equal payloads are written once: the row with the largest page_id is the response, the others are revisits that name it.
A null page_id ranks below all others; null html is an empty payload. page_id must be of a whole-number type. Rows that agree in
page_id, url and payload are told apart by the number of their copy; of rows that tie in page_id and payload, the last url is
the response's. Files go below the cluster's shared folder, and are written under a name of the task attempt,
renamed when whole, so that a repeated task leaves no half file that is read. An empty table gives no package and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, require, shared_folder

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Records and bytes that are read in one run, and about how many bytes of html go into one package.
READ_RUN, READ_BYTES, PACKAGE_BYTES = 512, 8 << 20, 64 << 20
#: Copies of one row that one task numbers.
COPIES = 10_000

_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    """A stored member: where its bytes begin inside the package, and how many there are."""

    name: str
    offset: int
    size: int


def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class PackageWriter:
    """Writes stored members one after another to a stream; sizes go to the central directory, so nothing is held.

    ``zip64_from`` is the size or place from which ZIP64 fields are used (tests lower it).
    """

    def __init__(self, out, zip64_from: int = _FULL32):
        self.out, self.at, self.done, self.limit = out, 0, [], zip64_from

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, parts: Iterator[bytes]) -> None:
        # Flag bit 3: checksum and size follow the data; every reader takes them from the central directory anyway.
        raw, begin = name.encode(), self.at
        self._put(_LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x0808, 0, 0, 0x21, 0, 0, 0, len(raw), 0) + raw)
        size, crc = 0, 0
        for part in parts:
            self._put(part)
            size, crc = size + len(part), zlib.crc32(part, crc)
        wide = size >= self.limit
        self._put(b"PK\x07\x08" + struct.pack("<IQQ" if wide else "<III", crc, size, size))
        self.done.append((raw, begin, size, crc))

    def close(self) -> None:
        begin = self.at
        for raw, offset, size, crc in self.done:
            extra = struct.pack("<QQ", size, size) * (size >= self.limit) + struct.pack("<Q", offset) * (offset >= self.limit)
            extra = struct.pack("<HH", 1, len(extra)) + extra if extra else b""
            s, o = (_FULL32 if size >= self.limit else size), (_FULL32 if offset >= self.limit else offset)
            self._put(_ENTRY + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x0808, 0, 0, 0x21, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, o) + raw + extra)
        size, n = self.at - begin, len(self.done)
        if begin >= self.limit or size >= self.limit or n >= _FULL16:
            end64 = self.at
            self._put(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, begin))
            self._put(_LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
            n, size, begin = _FULL16, _FULL32, _FULL32
        self._put(_END + struct.pack("<HHHHIIH", 0, 0, n, n, size, begin, 0))


def members(stream, length: int) -> dict[str, Member]:
    """Members of a package by name, from a seekable stream: the tail, the central directory, and each local header."""

    def at(offset: int, n: int) -> bytes:
        stream.seek(offset)
        return stream.read(n)

    tail_from = max(0, length - 65_557)
    tail = at(tail_from, length - tail_from)
    i = tail.rfind(_END, 0, max(0, len(tail) - 18))  # a comment may hold the mark itself: its length must fit
    while i >= 0 and i + 22 + struct.unpack_from("<H", tail, i + 20)[0] != len(tail):
        i = tail.rfind(_END, 0, i + len(_END) - 1)
    if i < 0:
        raise ValueError("no end record: not a ZIP package")
    n, size, begin = struct.unpack_from("<HII", tail, i + 10)
    if n == _FULL16 or size == _FULL32 or begin == _FULL32:
        where = tail_from + i - 20
        locator = at(where, 20) if where >= 0 else b""
        if locator[:4] == _LOCATOR64:
            record = at(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != _END64:
                raise ValueError("the ZIP64 end record isn't where its locator points")
            n, size, begin = struct.unpack_from("<QQQ", record, 32)
    directory, found, p = at(begin, size), {}, 0
    for _ in range(n):
        if directory[p : p + 4] != _ENTRY:
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, p + 10)
        packed, full, names, extras, notes = struct.unpack_from("<IIHHH", directory, p + 20)
        offset, = struct.unpack_from("<I", directory, p + 42)
        name, extra = directory[p + 46 : p + 46 + names], directory[p + 46 + names : p + 46 + names + extras]
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<HH", extra)
            if kind == 1:  # 64-bit values, only of the fields that are full, in this order
                wide = list(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                full = wide.pop(0) if full == _FULL32 else full
                packed = wide.pop(0) if packed == _FULL32 else packed
                offset = wide.pop(0) if offset == _FULL32 else offset
            extra = extra[4 + width :]
        if method == 0:
            local = at(offset, 30)
            if local[:4] != _LOCAL:
                raise ValueError("no local header where the directory points")
            a, b = struct.unpack_from("<HH", local, 26)
            found[name.decode()] = Member(name.decode(), offset + 30 + a + b, full)
        p += 46 + names + extras + notes
    return found


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(kind: str, key: str, url: str | None, digest: str, payload_bytes: int, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record. A revisit carries no payload; its payload's length is in an extension field."""
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{key}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(payload_bytes)),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        payload = b""
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    return head.encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    size = int(fields["content-length"])
    if len(body) < size:
        raise ValueError("cut record")
    return fields, body[:size]


def dedup_plan(pages: DataFrame) -> DataFrame:
    """One row per record to write: key, url, record_type, refers_to (a key), digest (hex), bytes, and html for responses only.

    Nothing here depends on the order in which the input is read, so a task that is run again makes the same records. Rows that
    agree in page_id, url and payload are alike, and are counted before they are told apart by the number of their copy. A
    payload's one response comes out of a grouping by digest, which meets equal payloads early; revisits never carry theirs.
    """
    html = F.coalesce("html", F.lit(""))
    page = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "url")
    taken = pages.select(page.alias("page"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    tag = F.substring(F.sha1(F.concat("digest", F.when(F.col("page.url").isNull(), "").otherwise(F.concat(F.lit("u"), "page.url")))), 1, 16)
    key = lambda copy: F.concat_ws(":", F.coalesce(F.col("page.page_id").cast("string"), F.lit("")), tag, copy.cast("string"))
    responses = taken.groupBy("digest").agg(F.max("page").alias("page"), F.first("html").alias("html"))

    alike = durable(taken.groupBy("digest", "page").agg(F.count("*").alias("n"), F.first(F.octet_length("html")).alias("bytes")))
    first = alike.groupBy("digest").agg(F.max("page").alias("best"))
    named = first.select("digest", "best", F.col("best").alias("page")).select("digest", "best", key(F.lit(0)).alias("refers_to"))
    others = alike.join(named, "digest")
    # Copy 0 of the best page is the response. Numbers are made block by block, so that no task makes all copies of a row.
    begin = F.when(F.col("page") == F.col("best"), 1).otherwise(0).cast("long")
    blocks = others.filter(F.col("n") > begin).withColumn("block", F.explode(F.sequence(begin, F.col("n") - 1, F.lit(COPIES))))
    dealt = blocks.repartition("digest", "page", "block")
    copies = dealt.withColumn("copy", F.explode(F.sequence("block", F.least(F.col("block") + COPIES, F.col("n")) - 1)))
    revisits = copies.select(key(F.col("copy")).alias("key"), F.col("page.url").alias("url"), F.lit("revisit").alias("record_type"), "refers_to", "digest", "bytes")
    written = responses.select(key(F.lit(0)).alias("key"), F.col("page.url").alias("url"), F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), "digest", F.octet_length("html").alias("bytes"), "html")
    return written.unionByName(revisits, allowMissingColumns=True)


def write_packages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as packages below ``folder``; gives (path, records) per package."""
    pages = require(pages, "page_id", "url", "html")
    folder = folder or shared_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_uri(folder)
        fs.create_dir(base, recursive=True)
        name, stream, writer, index, places = "", None, None, [], []
        paths, sizes = [], []

        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*[b.column(c).to_pylist() for c in ("key", "url", "record_type", "refers_to", "digest", "bytes", "html")])

        source, ahead = rows(), None
        ahead = next(source, None)
        while ahead is not None:
            name = f"{base}/{uuid.uuid4().hex}"
            index, places = [], [0]

            def records() -> Iterator[bytes]:
                nonlocal ahead
                taken = 0
                while ahead is not None and taken < PACKAGE_BYTES:
                    key, url, kind, to, digest, size, html = ahead
                    payload = (html or "").encode()
                    digest = base64.b32encode(bytes.fromhex(digest)).decode()
                    data = gzip.compress(warc_record(kind, key, url, digest, size, payload, to), 4, mtime=0)
                    index.append(json.dumps({"key": key, "offset": places[0], "length": len(data)}))
                    places[0] += len(data)
                    taken += len(payload) + 512
                    yield data
                    ahead = next(source, None)

            with fs.open_output_stream(name + ".part") as stream:
                writer = PackageWriter(stream)
                writer.member(DATA, records())
                writer.member(INDEX, iter([("\n".join(index) + "\n").encode()]))
                writer.close()
            fs.move(name + ".part", name + ".wacz")
            paths.append(f"{folder}/{name.rpartition('/')[2]}.wacz")
            sizes.append(len(index))
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "records"])

    # The list of finished packages is durable: files of a repeated or speculative attempt aren't on it.
    return durable(dedup_plan(pages).mapInArrow(run, "path string, records long"))


def split_packages(packages: DataFrame) -> DataFrame:
    """(path, offset, length, ranges): runs of the index's records, ``offset`` and ``length`` in bytes of the package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = open_uri(path)
                with fs.open_input_file(name) as stream:
                    found = members(stream, stream.size())
                    data, index = found[DATA], found[INDEX]
                    stream.seek(index.offset)
                    lines = [json.loads(x) for x in stream.read(index.size).decode().splitlines() if x]
                runs, size = [], 0
                for line in lines:  # a run ends at either bound; a longer record is a run of its own
                    if not runs or len(runs[-1]) == READ_RUN or size + line["length"] > READ_BYTES:
                        runs.append([])
                        size = 0
                    runs[-1].append(line)
                    size += line["length"]
                begins = [data.offset + r[0]["offset"] for r in runs]
                ends = [data.offset + r[-1]["offset"] + r[-1]["length"] for r in runs]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(runs), pa.string()), pa.array(begins, pa.int64()), pa.array([b - a for a, b in zip(begins, ends)], pa.int64()), pa.array([[x["length"] for x in r] for r in runs], pa.list_(pa.int64()))], names=["path", "offset", "length", "ranges"])

    return packages.select("path").mapInArrow(run, "path string, offset long, length long, ranges array<long>")


def read_records(splits: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records read from their ranges: page_id, url, record_type, payload_bytes, payload_digest, refers_to (and payload).

    A response's payload is hashed again and must match its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: int(x) if (x := urn[len("<urn:page:") : -1].partition(":")[0]) else None
        for batch in batches:
            for path, offset, length, ranges in zip(*[batch.column(c).to_pylist() for c in ("path", "offset", "length", "ranges")]):
                fs, name = open_uri(path)
                with fs.open_input_file(name) as stream:
                    stream.seek(offset)
                    data = stream.read(length)
                rows, at = [], 0
                for size in ranges:
                    fields, payload = parse_record(gzip.decompress(data[at : at + size]))
                    at += size
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (base32_sha1(payload) != digest or len(payload) != int(fields["x-payload-length"])):
                        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
                    rows.append((number(fields["warc-record-id"]), fields["warc-target-uri"], kind, int(fields["x-payload-length"]), digest, number(fields["warc-refers-to"]) if kind == "revisit" else None, payload if with_payload else None))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    out = splits.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
    return out if with_payload else out.drop("payload")


def read_packages(packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records of the packages; ranges are dealt out by place, so one large package is read by many tasks."""
    spark = packages.sparkSession
    splits = durable(split_packages(packages.repartition("path")))
    return read_records(splits.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "offset"), with_payload)
