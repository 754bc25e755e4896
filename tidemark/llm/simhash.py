"""SimHash fingerprints and near-duplicates among them, found with vantage-point trees.

``fingerprints`` hashes every word shingle of a whole text. ``linked`` joins fingerprints at a Hamming distance of at most
``radius``. If two fingerprints differ in at most r bits, then in one of k slices they differ in at most r // k; so each of
the ``slices`` gets a vantage-point tree of its own with that smaller radius, where the triangle bounds cut more. The upper
levels of a tree are built from a bounded sample and route fingerprints to shards: to the one they lie in, and to those
whose region a ball of the radius around them overlaps. Inside a shard the same splitting goes on until few are left, which
are then compared exactly over the whole fingerprint. A shard reports links as stars (each member to one of its group), so
a group of n copies gives about n links. A shard with too many rows is dealt out as pairs of its chunks, so no task holds
more than two of them.

``one_of_each`` finds near-duplicates by the similarity of shingle sets: fingerprints give the candidates, which fall into
blocks, and inside a block the sets themselves are compared.

Null texts count as empty; texts with no words have the fingerprint zero, linked like any other. Equal fingerprints are
merged before the search, so exact copies in any number cost one row there. Rows with a null id get a fingerprint and take
part in links but can't name a group while there is another id in it. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, fresh, require
from tidemark.llm.components import components
from tidemark.llm.tokens import _bytes

SEED = 42
#: Rows of the sample that the upper tree is built from, fingerprints that a shard should hold, and a leaf inside it.
SAMPLE, SHARD, LEAF = 20_000, 16_384, 1_024
#: Rows (at home or visiting) of a shard over which it is dealt out by chunks.
CROWD = 131_072

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of ``words`` lower-cased words, repeats included, as unsigned integers."""
    import xxhash

    parts = text.translate(_LOWER).split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(begins, ends[words - 1 :].tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; long texts are counted in blocks."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):
        block = hashes[i : i + 65_536]
        counts += np.unpackbits(block.astype("<u8").view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def remix(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Another 64 bits from each hash (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = hashes + np.uint64((0x9E3779B97F4A7C15 * salt) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprints(documents: DataFrame, words: int = 3, lanes: int = 1, id_column: str = "doc_id") -> DataFrame:
    """(id, fingerprint): the fingerprint is ``lanes`` times 64 bits, as that many signed longs f0, f1, ..."""
    rows = require(documents, id_column, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((lanes, batch.num_rows), dtype=np.uint64)
            seen: dict[bytes, int] = {}
            for i, text in enumerate(_bytes(batch.column("text"))):
                at = seen.setdefault(text, i)
                if at < i:
                    out[:, i] = out[:, at]
                    continue
                h = shingle_hashes(text, words)
                for lane in range(lanes):
                    out[lane, i] = majority(remix(h, lane) if lane else h) if len(h) else 0
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *[pa.array(x.view(np.int64)) for x in out]], names=["id", *[f"f{i}" for i in range(lanes)]])

    return rows.mapInArrow(run, f"id {rows.schema[id_column].dataType.simpleString()}, " + ", ".join(f"f{i} long" for i in range(lanes)))


@dataclass(frozen=True)
class Node:
    """Members nearer than ``cut`` to the vantage point are in ``near``, the others in ``far``; leaves are shard numbers."""

    point: int
    cut: int
    near: Node | int
    far: Node | int


def distances(a: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(a ^ point)


def choose(a: np.ndarray) -> tuple[int, int] | None:
    """A vantage point and the distance that splits ``a`` most evenly, of a few spread candidates; None if nothing splits."""
    best = None
    for i in np.linspace(0, len(a) - 1, num=min(5, len(a)), dtype=np.int64):
        d = distances(a, a[i])
        cut = int(np.median(d)) + 1
        for c in (cut - 1, cut):
            near = int((d < c).sum())
            if 0 < near < len(a) and (best is None or abs(2 * near - len(a)) < best[0]):
                best = abs(2 * near - len(a)), int(a[i]), c
    return best and best[1:]


def grow(sample: np.ndarray, depth: int, dtype) -> tuple[Node | int, int]:
    """The upper tree of a sample and how many shards it has."""
    shards = 0

    def part(a: np.ndarray, left: int) -> Node | int:
        nonlocal shards
        split = choose(a) if left and len(a) > 1 else None
        if split is None:
            shards += 1
            return shards - 1
        d = distances(a, dtype(split[0]))
        return Node(*split, part(a[d < split[1]], left - 1), part(a[d >= split[1]], left - 1))

    return part(sample, depth), shards


def route(tree: Node | int, a: np.ndarray, radius: int, dtype) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, places in ``a``, whether at home): triangle bounds prune the shards that no ball of the radius reaches."""

    def walk(node, at: np.ndarray, home: np.ndarray):
        if isinstance(node, int):
            yield node, at, home
            return
        d = distances(a[at], dtype(node.point)).astype(np.int64)
        for child, inside, reached in ((node.near, d < node.cut, d - radius < node.cut), (node.far, d >= node.cut, d + radius >= node.cut)):
            if reached.any():
                yield from walk(child, at[reached], (home & inside)[reached])

    yield from walk(tree, np.arange(len(a)), np.ones(len(a), dtype=bool))


def leaves(piece: np.ndarray, home: np.ndarray, inner: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Split a shard further, down to ``LEAF`` places at home: (places, whether each is at home in this leaf).

    ``piece`` is the slice that the tree splits by. What doesn't split (a dense group) stays whole.
    """
    todo = [(np.arange(len(piece)), home)]
    while todo:
        at, own = todo.pop()
        if not own.any():
            continue
        split = choose(piece[at[own]]) if own.sum() > LEAF else None
        if split is None:
            yield at, own
            continue
        d = distances(piece[at], piece.dtype.type(split[0])).astype(np.int64)
        near, far = d - inner < split[1], d + inner >= split[1]
        todo += [(at[near], (own & (d < split[1]))[near]), (at[far], (own & (d >= split[1]))[far])]


def stars(whole: np.ndarray, piece: np.ndarray, home: np.ndarray, radius: int, inner: int) -> Iterator[tuple[int, int]]:
    """Links (i, j) that span every group of places joined by pairs, one of them at home, at ``radius`` or less and at
    ``inner`` or less within the slice.

    ``whole`` has a row per place and a column per 64 bits. A leaf is searched outwards from each place in turn; what joins
    a group leaves the search, so a group of near copies takes time in proportion to its size.
    """

    def near(i: int, others: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(np.bitwise_count(piece[others] ^ piece[i]) <= inner)
        return some[np.bitwise_count(whole[others[some]] ^ whole[i]).sum(axis=1, dtype=np.int64) <= radius]

    def without(places: np.ndarray, gone: np.ndarray) -> np.ndarray:
        return np.delete(places, gone) if len(gone) else places

    for at, own in leaves(piece, home, inner):
        left_home, left_visit = at[own], at[~own]
        while len(left_home):
            first, left_home = left_home[0], left_home[1:]
            queue = [(first, True)]
            while queue:
                i, at_home = queue.pop()
                some = near(i, left_home)
                for j in left_home[some].tolist():
                    yield int(first), j
                    queue.append((j, True))
                left_home = without(left_home, some)
                if at_home:  # two visitors meet in the shard where one of them is at home
                    some = near(i, left_visit)
                    for j in left_visit[some].tolist():
                        yield int(first), j
                        queue.append((j, False))
                    left_visit = without(left_visit, some)


def linked(prints: DataFrame, radius: int = 3, slices: int = 2, bits: int = 32, lanes: int = 1, inner: int | None = None, band: str | None = None) -> DataFrame:
    """Spanning links (a, b) among the rows of ``prints`` (node long, f0, f1, ...; checkpointed, distinct fingerprints).

    Every pair at ``radius`` or less, and at ``inner`` or less in one of the ``slices`` of so many ``bits``, is joined by a
    path of the links given; at ``inner`` = ``radius // slices`` (the default) that is every pair within the radius. With
    ``band`` (a column of whole numbers) only pairs in one band or two neighbouring ones count.
    """
    dtype = {16: np.uint16, 32: np.uint32, 64: np.uint64}[bits]
    inner = radius // slices if inner is None else inner
    lane_columns = [f"f{i}" for i in range(lanes)]
    prints = prints.select("node", *lane_columns, (F.col(band) if band else F.lit(0)).cast("int").alias("band"))
    largest = prints.groupBy("band").count().agg(F.max("count")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(largest, 1) / SHARD)))
    sample = prints.select(*lane_columns).orderBy(F.xxhash64(*lane_columns)).limit(SAMPLE).toPandas() if depth else None

    def whole_of(frame: pd.DataFrame) -> np.ndarray:
        return np.stack([frame[c].to_numpy(np.int64).view(np.uint64) for c in lane_columns], axis=1)

    def slice_of(whole: np.ndarray, k: int) -> np.ndarray:
        lane, place = divmod(k * bits, 64)
        return (whole[:, lane] >> np.uint64(place)).astype(dtype)

    trees = [grow(slice_of(whole_of(sample), k), depth, dtype)[0] if depth else 0 for k in range(slices)]
    routing = prints.sparkSession.sparkContext.broadcast(trees)  # bounded by SAMPLE

    def visits(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        whole, bands = whole_of(frame), frame["band"].to_numpy()
        for k, tree in enumerate(routing.value):
            for shard, at, home in route(tree, slice_of(whole, k), inner, dtype):
                for up in (0, 1) if band else (0,):  # a pair of neighbouring bands meets in the upper one
                    yield frame.iloc[at].assign(slice=k, shard=shard, band=bands[at] + up, home=home & (up == 0))

    place = ["slice", "band", "shard"]

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.concat([v.groupby(place, as_index=False).agg(n=("node", "size")) for v in visits(frame)] or [pd.DataFrame(columns=[*place, "n"])])

    crowds = prints.mapInPandas(tally, "slice int, band int, shard int, n long").groupBy(*place).agg(F.sum("n").alias("n")).filter(F.col("n") > CROWD).collect()
    chunks = prints.sparkSession.sparkContext.broadcast({(r["slice"], r["band"], r["shard"]): math.ceil(r["n"] / CROWD) + 1 for r in crowds})

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for v in visits(frame):
                v = v.assign(cell=0)
                if not chunks.value:
                    yield v
                    continue
                for key, some in v.groupby(place):
                    k = chunks.value.get(key, 1)
                    own = some["node"].to_numpy() % k
                    for other in range(k):
                        both = some[own != other] if k > 1 else some
                        mine = own[own != other] if k > 1 else own
                        yield both.assign(cell=np.minimum(mine, other) * k + np.maximum(mine, other))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        whole, nodes = whole_of(frame), frame["node"].to_numpy(np.int64)
        found = list(stars(whole, slice_of(whole, int(frame["slice"].iloc[0])), frame["home"].to_numpy(bool), radius, inner))
        at = np.array(found, dtype=np.int64).reshape(-1, 2)
        # A star's centre becomes its smallest node, so that shards which find the same group give the same links.
        centres, star = np.unique(at[:, 0], return_inverse=True)
        low = nodes[centres].copy()
        np.minimum.at(low, star, nodes[at[:, 1]])
        a, b = np.concatenate([low[star], low]), np.concatenate([nodes[at[:, 1]], nodes[centres]])
        return pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    schema = "node long, " + "".join(f"{c} long, " for c in lane_columns) + "band int, slice int, shard int, home boolean, cell long"
    return prints.mapInPandas(spread, schema).groupBy(*place, "cell").applyInPandas(search, "a long, b long").distinct()


def group(prints: DataFrame, radius: int = 3, slices: int = 2, bits: int = 32, lanes: int = 1) -> DataFrame:
    """``prints`` (id, f0, ...) with component_id, the smallest id that chains of links reach."""
    lane_columns = [f"f{i}" for i in range(lanes)]
    prints = durable(prints)
    distinct = durable(prints.groupBy(*lane_columns).agg(F.min("id").alias("node")).filter("node IS NOT NULL"))
    found = components(linked(distinct, radius, slices, bits, lanes))
    labels = distinct.join(found, "node", "left").select(*[F.col(c).alias(f"l_{c}") for c in lane_columns], F.coalesce("component", "node").alias("component_id"))
    same = [F.col(c) == F.col(f"l_{c}") for c in lane_columns]
    return prints.join(labels, same, "left").drop(*[f"l_{c}" for c in lane_columns])


def near_duplicates(documents: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """(id, f0, component_id) per row of ``documents``."""
    return group(fingerprints(documents, words), radius)


#: The pipeline's near-duplicates: five-word shingles with a Jaccard similarity of 0.8 or more. Over 128 bits such a pair
#: differs in 19 bits on average (angle / pi of the cosine 2 * 0.8 / 1.8) with a deviation of 4; 32 bits leave room.
SIMILAR_WORDS, SIMILAR, SIMILAR_LANES, SIMILAR_RADIUS = 5, 0.8, 2, 32
#: Search slices of 16 bits with a radius of 2 each: for a pair at 0.8 one of the eight is that near with probability 0.998.
SIMILAR_SLICES, SIMILAR_BITS, SIMILAR_INNER = 8, 16, 2
#: Texts, and their shingles, over which a block is compared by chunks in several tasks; chunks are of half that.
BLOCK_TEXTS, BLOCK_SHINGLES = 4_096, 2_000_000
#: Texts of a large block that are compared with all of it in the first rounds; the last takes all that are left to do.
HUBS = (64, 512)


def similar(common: np.ndarray, a: np.ndarray | int, b: np.ndarray | int, least: float) -> np.ndarray:
    """Whether the Jaccard similarity is ``least`` or more; two empty sets are alike."""
    return common >= least * (a + b - common)


class Sets:
    """Shingle sets of a block, for counting what one of them shares with each."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], dtype=np.int64)
        _, ids, counts = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)
        several = counts > 1  # what one set alone has is in no intersection
        held = several[ids]
        owner = np.repeat(np.arange(len(sets)), self.sizes)[held]
        self.ids = (np.cumsum(several) - 1)[ids[held]].astype(np.int32)
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sets)))])
        self.mark = np.zeros(int(several.sum()), dtype=bool)

    def common(self, i: int) -> np.ndarray:
        """How many shingles set i shares with each set."""
        own = self.ids[self.ends[i] : self.ends[i + 1]]
        self.mark[own] = True
        sums = np.concatenate([[0], np.cumsum(self.mark[self.ids], dtype=np.int32)])
        self.mark[own] = False
        return sums[self.ends[1:]] - sums[self.ends[:-1]]

    def alike(self, i: int, least: float) -> np.ndarray:
        return similar(self.common(i), self.sizes[i], self.sizes, least)


def classes(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each set the first one that chains of alike sets reach."""
    block, label = Sets(sets), np.full(len(sets), -1)
    for first in range(len(sets)):
        if label[first] >= 0:
            continue
        label[first], queue = first, [first]
        while queue and (label < 0).any():
            new = np.flatnonzero(block.alike(queue.pop(), least) & (label < 0))
            label[new] = first
            queue += new.tolist()
    return label


def _shingle_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u8")


def blocks_in_one_task(members: DataFrame, least: float) -> DataFrame:
    """(digest, class) of ``members`` (block, digest, shingles) of small blocks: a block's rows are read one after another."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ("block", "digest", "shingles")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
            names = [d for d, _ in held]
            label = classes([_shingle_set(x) for _, x in held], least)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([names[i] for i in label], pa.string())], names=["digest", "class"])

        at, held = None, []
        for block, digest, shingles in rows(batches):
            if block != at and held:
                yield close(held)
                held = []
            at = block
            held.append((digest, shingles))
        if held:
            yield close(held)

    placed = members.repartition("block").sortWithinPartitions("block", "digest")
    return placed.select("block", "digest", "shingles").mapInArrow(run, "digest string, class string")


def against_all(queries: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between ``queries`` and the texts of their block that are alike; both have block, digest, chunk, chunks and
    shingles, members also the label of their component.

    A task compares one chunk of the queries with one of the members. Of the members of one component a query names one.
    """
    copies = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    left = queries.select("block", F.col("chunk").alias("q"), copies.alias("m"), F.lit(True).alias("asks"), "digest", F.lit("").alias("label"), "shingles")
    right = members.select("block", copies.alias("q"), F.col("chunk").alias("m"), F.lit(False).alias("asks"), "digest", "label", "shingles")
    right = right.join(left.select("block", "q").distinct(), ["block", "q"], "left_semi").select(*left.columns)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy(bool)
        sets, found = Sets([_shingle_set(x) for x in frame["shingles"]]), []
        names, labels = frame["digest"].to_numpy(), frame["label"].to_numpy()
        for i in np.flatnonzero(asks):
            alike = np.flatnonzero(sets.alike(i, least) & ~asks)
            one = alike[np.unique(labels[alike].astype(str), return_index=True)[1]]
            found += [(names[i], names[j]) for j in one if names[i] != names[j]]
        return pd.DataFrame(found, columns=["a", "b"], dtype=object)

    return left.union(right).groupBy("block", "q", "m").applyInPandas(run, "a string, b string")


def blocks_by_chunks(members: DataFrame, least: float) -> DataFrame:
    """(digest, class) of ``members`` (block, digest, shingles, chunks) of large blocks.

    A few texts of a block are compared with all of it, then some more, at last all that are still outside the block's
    largest component; each pair that isn't joined by links then has an end that was compared with the whole block.
    """
    members = durable(members.withColumn("chunk", F.pmod(F.xxhash64("digest"), F.col("chunks"))))
    links, asked = None, None
    labelled = members.withColumn("label", F.col("digest"))
    for most in (*HUBS, None):
        ahead = labelled.select("block", "digest", "label")
        if links is not None:
            sizes = ahead.groupBy("block", "label").count().groupBy("block").agg(F.max_by("label", F.struct("count", "label")).alias("largest"))
            ahead = ahead.join(sizes, "block").filter(F.col("label") != F.col("largest")).join(asked, "digest", "left_anti")
        if most:
            order = Window.partitionBy("block").orderBy(F.xxhash64("digest"), "digest")
            ahead = ahead.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
        queries = durable(members.join(ahead.select("digest"), "digest", "left_semi"))
        new = durable(against_all(queries, labelled, least))
        links = new if links is None else links.union(new)
        asked = queries.select("digest") if asked is None else asked.union(queries.select("digest"))
        found = durable(components(links).select(F.col("node").alias("digest"), F.col("component").alias("label")))
        labelled = members.join(found, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    return labelled.select("digest", F.col("label").alias("class"))


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(digest, shingles) of ``texts`` (digest, text): the sorted hashes of the shingle set; equal texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x, words)).astype("<u8").tobytes() for x in _bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(sets, pa.binary())], names=["digest", "shingles"])

    return texts.select("digest", "text").mapInArrow(run, "digest string, shingles binary").groupBy("digest").agg(F.first("shingles").alias("shingles"))


def set_prints(texts: DataFrame, words: int, lanes: int) -> DataFrame:
    """``texts`` (doc_id, digest, text) without text, with f0, f1, ... over the whole text and the size of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = np.zeros((lanes, batch.num_rows), dtype=np.uint64), np.zeros(batch.num_rows, dtype=np.int64)
            seen: dict[bytes, int] = {}
            for i, text in enumerate(_bytes(batch.column("text"))):
                at = seen.setdefault(text, i)
                if at < i:
                    out[:, i], sizes[i] = out[:, at], sizes[at]
                    continue
                h = np.unique(shingle_hashes(text, words))
                sizes[i] = len(h)
                for lane in range(lanes):
                    out[lane, i] = majority(remix(h, lane) if lane else h) if len(h) else 0
            columns = [batch.column("doc_id"), batch.column("digest"), *[pa.array(x.view(np.int64)) for x in out], pa.array(sizes)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", *[f"f{i}" for i in range(lanes)], "size"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "digest", "text").mapInArrow(run, f"doc_id {kind}, digest string, " + "".join(f"f{i} long, " for i in range(lanes)) + "size long")


def similar_texts(texts: DataFrame, prints: DataFrame, words: int = SIMILAR_WORDS, least: float = SIMILAR) -> DataFrame:
    """(digest, class) of the texts that may have another alike to them: texts in one class are joined by chains of pairs with
    a Jaccard similarity of ``least`` or more.

    ``texts``: digest, text. ``prints``: one row per text: digest, f0, f1, ..., size. Fingerprints near each other, of sets
    whose sizes allow the similarity, link up to blocks; inside a block the sets are compared, so a class is exact for all
    pairs whose fingerprints met.
    """
    lane_columns = [f"f{i}" for i in range(SIMILAR_LANES)]
    noded = prints.withColumn("node", F.xxhash64(*lane_columns, "size"))  # equal nodes only share a block
    # Sets whose sizes differ by more than 1 / least aren't alike; a band is a little wider than that.
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(1.0001 / least)).alias("band")
    nodes = durable(noded.filter("size > 0").select("node", *lane_columns, band).distinct())
    near = linked(nodes, SIMILAR_RADIUS, SIMILAR_SLICES, SIMILAR_BITS, SIMILAR_LANES, SIMILAR_INNER, "band")
    blocks = components(near).withColumnRenamed("component", "block")
    placed = durable(noded.join(blocks, "node", "left").select("digest", "size", F.coalesce("block", "node").alias("block")))
    chunks = F.greatest(F.ceil(2 * F.col("n") / BLOCK_TEXTS), F.ceil(2 * F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = placed.groupBy("block").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).filter("n > 1")
    placed = durable(placed.join(sizes.select("block", chunks.alias("chunks")), "block").select("block", "digest", "chunks"))
    sets = durable(shingle_sets(texts.join(placed, "digest", "left_semi"), words).join(placed, "digest"))
    few = blocks_in_one_task(sets.filter("chunks <= 2"), least)
    many = sets.filter("chunks > 2")
    return few if many.isEmpty() else few.union(blocks_by_chunks(many, least))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest doc_id stays, with all its columns.

    Groups are chains of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more (see
    ``similar_texts``); exact copies are one text from the start, and texts without words are alike to each other. A null
    doc_id stays only where its group has no other. Of rows that agree in doc_id and text the first in the order of all
    columns, written as JSON, stays.
    """
    digest = fresh(documents, "digest")
    texts = documents.select(F.col("`doc_id`").alias("doc_id"), F.coalesce(F.col("`text`"), F.lit("")).alias("text"))
    texts = texts.withColumn("digest", F.md5("text"))
    lane_columns = [f"f{i}" for i in range(SIMILAR_LANES)]
    rows = set_prints(texts, SIMILAR_WORDS, SIMILAR_LANES).groupBy("digest", "doc_id", *lane_columns, "size").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "copies")).alias("first")
    reps = durable(rows.groupBy("digest", *lane_columns, "size").agg(first).select("digest", *lane_columns, "size", "first.doc_id", "first.copies"))
    named = reps.join(similar_texts(texts, reps.select("digest", *lane_columns, "size")), "digest", "left")
    keeper = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "copies")).alias("k")
    stay = durable(named.groupBy(F.coalesce("class", "digest")).agg(keeper).select(F.col("k.doc_id").alias("stay_id"), F.col("k.digest").alias("stay_digest"), F.col("k.copies").alias("stay_copies")))
    numbered = documents.withColumn(digest, F.md5(F.coalesce(F.col("`text`"), F.lit(""))))

    def those(which: DataFrame) -> DataFrame:
        one, two = fresh(numbered, "stay_digest"), fresh(numbered, "stay_id")
        which = which.select(F.col("stay_digest").alias(one), F.col("stay_id").alias(two))
        return numbered.join(which, (F.col(f"`{digest}`") == F.col(one)) & F.col("`doc_id`").eqNullSafe(F.col(two)), "left_semi")

    once = those(stay.filter("stay_copies = 1")).drop(digest)
    if (repeated := stay.filter("stay_copies > 1")).isEmpty():
        return once
    columns = [F.col(f"`{c}`") for c in documents.columns]
    chosen = those(repeated).groupBy(digest, "doc_id").agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias("row"))
    return once.union(chosen.select("row.*"))
