"""URL filters: domain rules first, then naive Bayes over segmented host and path tokens.

Rules are a driver-side list; a rule fits its host and all subdomains if the url's path begins with the rule's path; the
longest rule (host and path together, then the host) wins. For urls without a rule, each host label is split into words by
a Viterbi search over a unigram model, whose counts come from the words of all pages, and a multinomial naive Bayes
classifier, trained on the urls that a rule decides, scores the tokens.

Words may have any length. Those over 63 letters and those that aren't among the most frequent are joined to the urls that
have them, not broadcast; a filter of fixed size keeps most other substrings of a url out of that join.

A null url, or one without ``://``, has an empty host and path and no tokens: the class priors decide. Without any url of
one class (or an empty table) the verdict of the method is allow. Repeated rows are judged one by one; other columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, require


@dataclass(frozen=True)
class Rule:
    verdict: str  # block or allow
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

#: Bounds of what is broadcast: the most frequent words of the unigram model and tokens of the classifier. The others are
#: joined to the urls that need them.
UNIGRAMS, TOKENS = 50_000, 50_000
#: Letters of the longest word that is broadcast, so that what is broadcast is bounded in bytes. Longer ones are joined, too.
LONGEST_BROADCAST = 63
#: Bits of the filter that keeps substrings of a url from the join with the words which aren't broadcast.
FILTER_BITS = 1 << 22


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The winning rule as struct<name, verdict>, or null. The rules become one chain of tests, longest first."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def frequent(counts: DataFrame, n: Column, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``counts`` in two: the rows of the largest counts, at most ``most`` of them, and the others (None if there are none).

    The former are those at or above a bound, which is the lowest eighth of an octave that leaves no more. Only a histogram
    of a few hundred rows is gathered to find it."""
    step = F.floor(F.log2(n) * 8)
    rows, bound = 0, None
    for step_, size in sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True):
        if rows + size > most:
            return (counts.limit(0), counts) if bound is None else (counts.filter(step >= bound), counts.filter(step < bound))
        rows, bound = rows + size, step_
    return counts, None


@dataclass(frozen=True)
class Unigrams:
    """Word counts: the frequent ones, a table (word, n) of the rare ones or None, and the sum of all."""

    counts: dict[str, int]
    rare: DataFrame | None
    total: int


def unigrams(texts: DataFrame, column: str) -> Unigrams:
    """Counts of the lower-cased a-z words outside tags, counted over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, word = re.compile(r"<[^>]*>"), re.compile(r"[a-z]+")
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column(column).to_pylist():
                counts.update(word.findall(tag.sub(" ", (text or "").lower())))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counts = require(texts, column).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = durable(counts)
    short = F.length("word") <= LONGEST_BROADCAST
    top, rare = frequent(counts.filter(short), F.col("n"), UNIGRAMS)
    long = counts.filter(~short)
    if not long.isEmpty():
        rare = long if rare is None else rare.union(long)
    return Unigrams({r["word"]: r["n"] for r in top.collect()}, rare, counts.agg(F.sum("n")).first()[0] or 0)


def segmenter(counts: dict[str, int], total: int | None = None):
    """A function that splits a label into words: the split with the highest product of unigram probabilities.

    Its second argument has pairs (word, count) of the label's substrings that ``counts`` lacks. A run outside the model costs as much as a word seen ``1 / 10**length`` times.
    """
    total = total or sum(counts.values()) or 1
    cost = {w: math.log(total / n) for w, n in counts.items()}
    unknown, per_letter = math.log(total), math.log(10)
    lengths = {len(w) for w in cost}

    @lru_cache(maxsize=100_000)
    def split(label: str, rare: tuple[tuple[str, int], ...] = ()) -> tuple[str, ...]:
        more = {w: math.log(total / n) for w, n in rare}
        steps = sorted(lengths.union(map(len, more)), reverse=True)
        best = [(0.0, 0)]
        outside = (0.0, 0)  # the cheapest start of a run outside the model, its letters up to there taken off
        for end in range(1, len(label) + 1):
            outside = min(outside, (best[-1][0] - per_letter * (end - 1), end - 1))
            found = (outside[0] + unknown + per_letter * end, outside[1])
            for size in steps:
                if size <= end:
                    w = label[end - size : end]
                    price = cost[w] if w in cost else more.get(w)
                    if price is not None:
                        found = min(found, (best[end - size][0] + price, end - size))
            best.append(found)
        words, end = [], len(label)
        while end:
            start = best[end][1]
            words.append(label[start:end])
            end = start
        return tuple(reversed(words))

    return split


def url_tokens(host: str, path: str, split) -> list[str]:
    """h:WORD for the words of the host's labels, p:WORD for the words of the path; numbers become one token."""
    out = []
    for kind, text in (("h", host), ("p", path.lower())):
        for part in re.findall(r"[^\W\d_]+|\d+", text):
            out += [f"{kind}:0"] if part[0].isdigit() else [f"{kind}:{w}" for w in split(part)]
    return out


def word_filter(rare: DataFrame) -> tuple[list[int], list[int]]:
    """The lengths of the words of ``rare``, and a filter of ``FILTER_BITS`` bits, in 64s, in which each word sets the bit that its
    crc32 names. Both are bounded, whatever the number of words; a full filter lets all through to the join."""
    place = F.crc32(F.col("word").cast("binary")) % FILTER_BITS
    bits = rare.select(place.alias("at")).select(F.floor(F.col("at") / 64).alias("slot"), F.expr("shiftleft(1L, CAST(at % 64 AS INT))").alias("bit"))
    slots = [0] * (FILTER_BITS // 64)
    for r in bits.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        slots[r["slot"]] = r["bits"] % (1 << 64)
    return sorted(r["size"] for r in rare.select(F.length("word").alias("size")).distinct().collect()), slots


def rare_words(pages: DataFrame, counts, rare: DataFrame) -> DataFrame:
    """(row, rare): per row of ``pages`` (row, host, path) the parts of its url that have words of ``rare`` in them, with
    those words. ``counts`` is the broadcast of the frequent words."""

    shared = pages.sparkSession.sparkContext.broadcast(word_filter(rare))

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, str]] = []
            for row, host, path in zip(*[batch.column(c).to_pylist() for c in ("row", "host", "path")]):
                parts: dict[str, None] = {}
                url_tokens(host, path, lambda part: parts.setdefault(part) or ())  # noqa: B023
                found += [(row, part) for part in parts]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())], names=["row", "part"])

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, run = counts.value, re.compile("[a-z]+")
        lengths, slots = shared.value
        for batch in batches:
            for part in batch.column("part").to_pylist():
                words = set()
                for x in run.findall(part):
                    letters = x.encode()
                    for size in lengths:
                        for i in range(len(x) - size + 1):
                            at = crc32(letters[i : i + size]) % FILTER_BITS
                            if slots[at >> 6] >> (at & 63) & 1:
                                words.add(x[i : i + size])
                words = [w for w in words if w not in known]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(words), pa.string()), pa.array(words, pa.string())], names=["part", "word"])

    parts = pages.select("row", "host", "path").mapInArrow(parts_of, "row long, part string")
    words = parts.select("part").distinct().mapInArrow(substrings, "part string, word string").join(rare, "word")
    words = words.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("words"))
    return parts.join(words, "part").groupBy("row").agg(F.collect_list(F.struct("part", "words")).alias("rare"))


def tokenise(pages: DataFrame, words: Unigrams) -> DataFrame:
    """``pages`` (row, page_id, host, path, rule; checkpointed) with tokens."""
    model = pages.sparkSession.sparkContext.broadcast(words.counts)
    total = words.total
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    names = pages.columns
    if words.rare is not None:
        pages = pages.join(rare_words(pages, model, words.rare), "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = segmenter(model.value, total)
        for batch in batches:
            rare = batch.column("rare").to_pylist() if "rare" in batch.schema.names else [None] * batch.num_rows
            tokens = []
            for host, path, more in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), rare):
                own = {x["part"]: tuple((w["word"], w["n"]) for w in x["words"]) for x in more or ()}
                tokens.append(url_tokens(host, path, lambda part: split(part, own.get(part, ()))))  # noqa: B023
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(tokens, pa.list_(pa.string()))], names=[*names, "tokens"])

    return pages.mapInArrow(run, f"{kinds}, tokens array<string>")


@dataclass(frozen=True)
class Bayes:
    """Log-odds of block against allow: a prior, one weight per frequent token, the weight of a token outside the model, and
    a table (token, weight) of the rare tokens or None."""

    prior: float
    weights: dict[str, float]
    other: float
    rare: DataFrame | None = None


def train(tokenised: DataFrame) -> Bayes:
    """Multinomial naive Bayes with add-one smoothing from all urls that a rule decides."""
    known = tokenised.filter(F.col("rule").isNotNull()).select(F.col("rule.verdict").alias("verdict"), "tokens")
    rows = {r["verdict"]: r["count"] for r in known.groupBy("verdict").count().collect()}
    if not rows.get("block") or not rows.get("allow"):
        return Bayes(-1.0, {}, 0.0)
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    tokens = known.select("verdict", F.explode("tokens").alias("token")).groupBy("token").agg(count("block"), count("allow"))
    tokens = durable(tokens)
    sums = tokens.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count("*").alias("n")).first()
    n, block, allow = sums["n"] or 0, sums["block"] or 0, sums["allow"] or 0
    norm = math.log((allow + n + 1) / (block + n + 1))
    top, rare = frequent(tokens, F.col("block") + F.col("allow"), TOKENS)
    weights = {r["token"]: math.log((r["block"] + 1) / (r["allow"] + 1)) + norm for r in top.collect()}
    rare = rare and rare.select("token", (F.log((F.col("block") + 1) / (F.col("allow") + 1)) + norm).alias("weight"))
    return Bayes(math.log(rows["block"] / rows["allow"]), weights, norm, rare)


def rare_weights(tokenised: DataFrame, weights, rare: DataFrame) -> DataFrame:
    """(row, rare): per row the tokens of ``rare`` in it with their weights. ``weights`` is the broadcast of the frequent ones,
    which are never joined."""

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights.value
        for batch in batches:
            found = [(row, t) for row, tokens in zip(batch.column("row").to_pylist(), batch.column("tokens").to_pylist()) for t in dict.fromkeys(tokens) if t not in known]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())], names=["row", "token"])

    asked = tokenised.select("row", "tokens").mapInArrow(others, "row long, token string")
    return asked.join(rare, "token").groupBy("row").agg(F.collect_list(F.struct("token", "weight")).alias("rare"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the classifier's log-odds of block (positive: block)."""
    rows = require(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("row", F.monotonically_increasing_id())
    tokenised = durable(tokenise(durable(rows), unigrams(pages, "html")))
    bayes = train(tokenised)
    weights = tokenised.sparkSession.sparkContext.broadcast(bayes.weights)
    prior, other = bayes.prior, bayes.other
    if bayes.rare is not None:
        tokenised = tokenised.join(rare_weights(tokenised, weights, bayes.rare), "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights.value
        for batch in batches:
            rare = batch.column("rare").to_pylist() if "rare" in batch.schema.names else [None] * batch.num_rows
            odds = []
            for tokens, more in zip(batch.column("tokens").to_pylist(), rare):
                own = {x["token"]: x["weight"] for x in more or ()}
                odds.append(prior + sum(known[t] if t in known else own.get(t, other) for t in tokens))
            keep = [batch.column(c) for c in ("page_id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(odds, pa.float64())], names=["page_id", "host", "path", "rule", "log_odds"])

    kind = rows.schema["page_id"].dataType.simpleString()
    scored = tokenised.mapInArrow(run, f"page_id {kind}, host string, path string, rule struct<name:string,verdict:string>, log_odds double")
    verdict = F.coalesce(F.col("rule.verdict"), F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("rule.name").alias("rule"), verdict.alias("verdict"), "log_odds")
