"""Phrases whose words keep company: set-oriented mining over sorted occurrence relations.

``mine`` counts words, numbers those that occur often enough, and writes the relation R1(doc, pos, id), bucketed by document
and sorted by position. From R(k) it gets R(k+1) by a merge join of R(k) with itself at the next position, counts its groups
(left part, right part), keeps the frequent ones and semi-joins the relation with them before the next length. A phrase of
k + 1 words can't be frequent unless both its parts of k words are, so nothing is lost. Buckets keep the rows of a document
together, so the joins shuffle nothing; counts are summed before they are shuffled.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words at blanks and tabs; a cut takes a place
of its own, so that words of different pieces are never neighbours. Words are told apart by a 64-bit hash of language and
word; a seed under which two words of the corpus share a hash isn't used.

Null texts count as empty, a null language as ``und``. Repeated rows count as often as they stand there. Empty tables give no
rows. Other columns aren't read. Documents are numbered by their place in the input, which must read alike twice, as files
do; the relation's size is held against the counts, so that a change is an error and no loss.
"""

from __future__ import annotations

import itertools
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import require, session_with, shared_folder, stored
from tidemark.llm.tokens import _bytes

#: A group counts as frequent from so many occurrences on; phrases have at most so many words.
LEAST, LONGEST = 30, 4
#: A candidate goes if a longer one that holds it occurs at least so many times in a hundred of its own.
INSIDE = 80
#: Rows of a language in the report.
REPORT = 2000
#: Groups are sent to every executor up to this number of rows (some 100 bytes each), and joined by a shuffle beyond it.
BROADCAST = 1_000_000
#: Words of documents that go to the JVM together.
CHUNK = 200_000

_CUT = b"\xff"  # no byte of UTF-8
_FOLD = bytes(255 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, with a cut where a piece ends."""
    return text.translate(_FOLD).replace(_CUT, b" \xff ").split()


class Keys(dict):
    """Hashes of the words of a language, as they are asked for; a cut's is 0."""

    def __init__(self, lang: str, seed: int):
        name = lang.encode()
        self.head, self.seed = len(name).to_bytes(4, "little") + name, seed
        self[_CUT] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:  # only a memory: asked again, a word gets the same hash
            self.clear()
            self[_CUT] = 0
        key = xxhash.xxh64_intdigest(self.head + word, self.seed)
        self[word] = key = key - (1 << 64) if key >> 63 else key
        return key


def _languages(batch: pa.RecordBatch) -> list[str]:
    return batch.column("lang").to_pylist()


def count_words(documents: DataFrame, seed: int) -> DataFrame:
    """key, lang, word, n, and whether other words share the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(_languages(batch), _bytes(batch.column("text"))):
                counts.setdefault(lang, Counter()).update(tokens(text))
            for lang, found in counts.items():
                found.pop(_CUT, None)
                keys, words = Keys(lang, seed), list(found)
                columns = [pa.array(map(keys.__getitem__, words), pa.int64(), size=len(words)), pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64(), size=len(words))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "lang", "word", "n"])

    return by_key(documents.mapInArrow(run, "key long, lang string, word string, n long"))


def by_key(counts: DataFrame) -> DataFrame:
    found = counts.groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))
    both = F.struct("lang", "word")
    out = found.groupBy("key").agg(F.min(both).alias("one"), F.max(both).alias("other"), F.sum("n").alias("n"))
    return out.select("key", "one.lang", "one.word", "n", ((F.col("one") != F.col("other")) | (F.col("key") == 0)).alias("shared"))


def occurrences(documents: DataFrame, seed: int) -> DataFrame:
    """doc, pos, key of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Keys] = {}

        def rows(part: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            keys = np.concatenate([k for _, k in part])
            docs = np.repeat(np.array([d for d, _ in part], dtype=np.int64), [len(k) for _, k in part])
            places = np.concatenate([np.arange(len(k), dtype=np.int32) for _, k in part])
            words = keys != 0
            return pa.RecordBatch.from_arrays([pa.array(docs[words]), pa.array(places[words]), pa.array(keys[words])], names=["doc", "pos", "key"])

        for batch in batches:
            part, size = [], 0
            for doc, lang, text in zip(batch.column("doc").to_pylist(), _languages(batch), _bytes(batch.column("text"))):
                found = tokens(text)
                keys = known.setdefault(lang, Keys(lang, seed))
                part.append((doc, np.fromiter(map(keys.__getitem__, found), dtype=np.int64, count=len(found))))
                size += len(found)
                if size >= CHUNK:
                    yield rows(part)
                    part, size = [], 0
            if part:
                yield rows(part)

    return documents.mapInArrow(run, "doc long, pos int, key long")


def numbered(table: DataFrame, name: str) -> DataFrame:
    """``table`` stored, with the numbers 0, 1, 2 ... in column ``name``."""
    out = stored(table.withColumn(name, F.monotonically_increasing_id()))
    part, row = F.shiftright(name, 33), F.col(name).bitwiseAND((1 << 33) - 1)
    sizes = out.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row per file
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return out.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, row + F.col("_start")).drop("_part", "_start")


class Relations:
    """Bucketed tables of (doc, pos, id), outside the session's own names, in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.names = spark, shared_folder(spark, "occurrences"), []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, rows: DataFrame) -> DataFrame:
        name = f"tidemark_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "doc").sortBy("doc", "pos").option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def close(self) -> None:
        """Forget the names. The files stay, as those of checkpoints do, until the shared folder is cleaned."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST else table


def mine(documents: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, n) and candidate phrases: lang, k, phrase, a, pre, suf, longer. ``pre`` and ``suf`` are the
    counts of both sides for every cut, ``longer`` the largest count of a candidate that has one word more and holds it."""
    spark = documents.sparkSession
    # Buckets by document serve a join by document and position: its own session says so, the caller's stays as it is.
    own = session_with(spark, **{"spark.sql.requireAllClusterKeysForCoPartition": "false"})
    texts = require(documents, "lang", "text").withColumn("lang", F.coalesce("lang", F.lit("und")))
    for seed in itertools.count():
        words = stored(count_words(texts, seed))
        if words.filter("shared").isEmpty():
            break
    frequent = stored(numbered(words.filter(F.col("n") >= least).select("key", "lang", "word", "n"), "id"))
    n_groups, total = frequent.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    relations = Relations(own)
    try:
        placed = texts.withColumn("doc", F.monotonically_increasing_id()).repartition(relations.buckets, "doc")
        relation = relations.write(occurrences(placed, seed).join(small(frequent.select("key", "id"), n_groups), "key").select("doc", "pos", "id"))
        if relation.count() != total:
            raise ValueError("the documents changed while they were read")
        none = F.array().cast("array<long>")
        groups = [frequent.select("id", "lang", F.col("word").alias("phrase"), F.col("n").alias("a"), none.alias("pre"), none.alias("suf"))]
        ends = []
        for k in range(2, longest + 1):
            left = relation.select("doc", (F.col("pos") + 1).alias("next"), "pos", F.col("id").alias("l"))
            right = relation.select(F.col("doc").alias("r_doc"), F.col("pos").alias("r_pos"), F.col("id").alias("r"))
            pairs = left.join(right.hint("merge"), (F.col("doc") == F.col("r_doc")) & (F.col("next") == F.col("r_pos"))).select("doc", "pos", "l", "r")
            counted = stored(numbered(pairs.groupBy("l", "r").agg(F.count("*").alias("a")).filter(F.col("a") >= least), "id"))
            n_groups = counted.count()
            if k < longest:
                kept = small(counted.select("l", "r", "id"), n_groups)
                relation = relations.write(pairs.join(kept, ["l", "r"]).select("doc", "pos", "id"))
            ends.append(stored(counted, spark))
            groups.append(stored(describe(ends[-1], groups[-1], k)))
    finally:
        relations.close()
    found = None
    for k, group in enumerate(groups[1:], 2):
        candidates = group.withColumn("k", F.lit(k))
        if k < longest:
            up = ends[k - 1]
            holders = up.select(F.col("l").alias("id"), "a").union(up.select("r", "a")).groupBy("id").agg(F.max("a").alias("longer"))
            candidates = candidates.join(holders, "id", "left")
        else:
            candidates = candidates.withColumn("longer", F.lit(None).cast("long"))
        candidates = candidates.select("lang", "k", "phrase", "a", "pre", "suf", "longer")
        found = candidates if found is None else found.unionByName(candidates)
    return words.select("lang", "word", "n"), found


def describe(counted: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """Phrases of ``k`` words from the two parts of k - 1 words that overlap in all but one word."""
    left = parts.select(F.col("id").alias("l"), "lang", F.col("phrase").alias("head"), F.col("a").alias("l_a"), F.col("pre").alias("l_pre"))
    right = parts.select(F.col("id").alias("r"), F.col("phrase").alias("tail"), F.col("a").alias("r_a"), F.col("suf").alias("r_suf"))
    return counted.join(left, "l").join(right, "r").select(
        "id",
        "lang",
        F.concat_ws(" ", "head", F.substring_index("tail", " ", -1)).alias("phrase"),
        "a",
        F.concat("l_pre", F.array("l_a")).alias("pre"),
        F.concat(F.array("r_a"), "r_suf").alias("suf"),
    )


def score(candidates: DataFrame) -> DataFrame:
    """The lowest-scoring cut of every candidate: score, l and r. Ties go to the cut after fewer words."""
    exact = lambda c: c.cast("decimal(20,0)")  # noqa: E731  products pass 64 bits
    candidates = candidates.withColumn("a20", exact(F.col("a")))
    cut = "named_struct('score', (2000000 * a20) div (cast(x as decimal(20,0)) + cast(suf[i] as decimal(20,0))), 'k', i, 'l', x, 'r', suf[i])"
    return candidates.withColumn("cut", F.expr(f"array_min(transform(pre, (x, i) -> {cut}))")).select("*", "cut.l", "cut.r", "cut.score").drop("cut", "a20")


def report(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = REPORT) -> DataFrame:
    """The first ``most`` phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    words, candidates = mine(documents, least, longest)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    kept = candidates.filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * INSIDE))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = score(kept).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return first.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
