"""Lexical and dense retrieval and their fusion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import forecast

K1, B, FUSION = 1.2, 0.75, 60
WORD = r"([\p{L}\p{N}]+)"
#: Queries that one dense search takes at once; their vectors are broadcast.
MOST_QUERIES = 10_000


def title_tokens(titles: DataFrame) -> DataFrame:
    """(id, token, tf, length): lower-cased runs of letters and digits."""
    rows = titles.select("id", title_words("title").alias("words")).select("id", F.size("words").alias("length"), F.explode("words").alias("token"))
    return rows.groupBy("id", "length", "token").agg(F.count("*").alias("tf"))


def bm25_stats(titles: DataFrame) -> DataFrame:
    """N and the mean length over all titles: one row."""
    return titles.agg(F.count("*").alias("docs"), F.avg(F.regexp_count(F.lower("title"), F.lit(WORD))).alias("mean_length"))


def title_words(title) -> Column:
    return F.regexp_extract_all(F.lower(title), F.lit(WORD), 1)


def spread(titles: DataFrame) -> DataFrame:
    """Dealt out by id where the table has fewer splits than there are cores, as one small file has; else as it is."""
    cores = titles.sparkSession.sparkContext.defaultParallelism
    return titles.repartition(2 * cores, "id") if titles.rdd.getNumPartitions() < cores else titles


def asked_phrases(queries: DataFrame) -> DataFrame:
    """query, asked: the words of each query's phrase, blank between them, and their number n. A phrase without words asks nothing."""
    words = title_words("phrase")
    return queries.select("query", words.alias("words")).filter(F.size("words") > 0).select("query", F.array_join("words", " ").alias("asked"), F.size("words").alias("n"))


def phrase_places(titles: DataFrame, lengths: list[int]) -> DataFrame:
    """(asked, id, length): every run of words side by side in a title that is as long as some phrase, as often as it comes."""

    def runs(words: Column, n: int) -> Column:
        places = F.sequence(F.lit(1), F.size(words) - n + 1)
        return F.when(F.size(words) >= n, F.transform(places, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    # The words come in as the variable of a lambda: as a column they would be cut out of the title again at every place.
    every = lambda words: F.struct(F.size(words).alias("length"), F.concat(F.array().cast("array<string>"), *[words if n == 1 else runs(words, n) for n in lengths]).alias("runs"))
    held = titles.select("id", F.explode(F.transform(F.array(title_words("title")), every)).alias("t"))
    return held.select("id", "t.length", F.explode("t.runs").alias("asked"))


def phrases(titles: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, tf, length): how often each title holds the words of each query's phrase side by side."""
    asked = forecast.reliable(asked_phrases(queries))
    return phrase_counts(titles, asked).join(asked.select("query", "asked"), "asked").select("query", "id", "length", "tf")


def phrase_counts(titles: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, id, length, tf) over distinct phrases: a title's runs of words meet whole phrases, so a frequent first word makes no
    row for each phrase that begins with it, and a phrase that many queries ask is looked for once."""
    lengths = sorted(r["n"] for r in asked.select("n").distinct().collect())  # lengths of phrases, in words
    found = phrase_places(spread(titles.select("id", "title")), lengths).join(asked.select("asked").distinct(), "asked", "left_semi")
    return found.groupBy("asked", "id", "length").agg(F.count("*").alias("tf"))


def bm25(titles: DataFrame, queries: DataFrame, most: int = 50) -> DataFrame:
    """Per query (query, phrase) the best titles that hold exactly this phrase, ties by id: query, id, score, rank.

    Phrases are counted, scored and cut to their best titles once each, whoever asks them; then queries take their phrase's list.
    """
    asked = forecast.reliable(asked_phrases(queries))
    found = forecast.reliable(phrase_counts(titles, asked))  # counted, then scored: titles are searched once
    df = found.groupBy("asked").agg(F.count("*").alias("df"))
    docs, mean_length = bm25_stats(titles).first()
    idf = F.log(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean_length or 1.0)))
    best = top(found.join(df, "asked").select("asked", "id", F.round(idf * tf, 6).alias("score")), most, "asked")
    return best.join(asked.select("query", "asked"), "asked").select("query", "id", "score", "rank")


def top(scored: DataFrame, most: int, key: str = "query") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= most)


def cosine(vectors: DataFrame, queries: DataFrame, most: int = 50) -> DataFrame:
    """The exact nearest vectors by cosine, ties by id. ``vectors``: id, vector; ``queries``: query, vector.

    Queries go in blocks of ``MOST_QUERIES`` at most, each broadcast in turn, so any number of them may be asked. A task multiplies
    its vectors with a block batch by batch and keeps one list of the best per query, whatever the number of its batches.
    """
    blocks = max(1, -(-queries.count() // (MOST_QUERIES // 2)))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    found = [_cosine_block(vectors, queries.filter(block == i) if blocks > 1 else queries, most) for i in range(blocks)]
    return top(reduce(lambda a, b: a.union(b), found), most)


def _cosine_block(vectors: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    asked = queries.limit(MOST_QUERIES + 1).toPandas()
    if len(asked) > MOST_QUERIES:
        raise ValueError("one block of queries is over the bound: are their names distinct?")
    names = asked["query"].to_numpy()
    matrix = np.stack(asked["vector"].to_numpy()).astype(np.float64) if len(asked) else np.zeros((0, 1))
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    shared = vectors.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, m = shared.value
        best_ids, best = None, None
        for b in batches:
            for begin in range(0, len(b) if len(names) else 0, 1024):
                part = b.iloc[begin : begin + 1024]
                x = np.stack(part["vector"].to_numpy()).astype(np.float64)
                scores = np.round((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)) @ m.T, 6).T
                ids = np.broadcast_to(part["id"].to_numpy(), scores.shape)
                if best is not None:
                    scores, ids = np.concatenate([best, scores], axis=1), np.concatenate([best_ids, ids], axis=1)
                order = np.lexsort((ids, -scores), axis=1)[:, :most]
                best, best_ids = np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)
        if best is not None:
            yield pd.DataFrame({"query": np.repeat(names, best.shape[1]), "id": best_ids.ravel(), "score": best.ravel()})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return vectors.select("id", "vector").mapInPandas(run, f"query {kind(queries, 'query')}, id {kind(vectors, 'id')}, score double")


def fuse(*ranked: DataFrame, most: int = 5) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1/(60 + rank) over rankers, ties by id."""
    parts = None
    for r in ranked:
        part = r.select("query", "id", (1.0 / (FUSION + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.union(part)
    return top(parts.groupBy("query", "id").agg(F.round(F.sum("part"), 9).alias("score")), most)


def hybrid(titles: DataFrame, vectors: DataFrame, phrase_queries: DataFrame, vector_queries: DataFrame) -> DataFrame:
    """C17: BM25 and cosine, fused; five titles per query. Refuses to run without vectors."""
    if vectors.isEmpty():
        raise ValueError("no vectors: make them first")
    return fuse(bm25(titles, phrase_queries), cosine(vectors, vector_queries))
