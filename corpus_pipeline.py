"""A corpus in five stages, each written as Parquet and read again by the next: toxicity, quality rules, near-duplicates,
mixing to target weights, packing. ``run`` chains them over the table documents.

The first four return the columns of documents, the last one row per packed piece. Every stage takes nulls in any column,
repeated rows and empty tables; what it makes of them is said in its operator's module.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, quality, simhash, toxicity
from tidemark.llm.common import fresh, shared_folder, table
from tidemark.llm.registry import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the labelled documents among ``docs``; those with a score of 0.5 or more go."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or a threshold rejects go."""
    measures = fresh(docs, "measures")
    return quality.judge(docs, into=measures).filter(F.col(measures)["kept"]).drop(measures)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and as far, as their source's target takes them, in training order."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in sequences of 2048 tokens."""
    return packing.pack(packing.cut(docs, vocabulary_path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing to target weights", mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs


#: A trained classifier and token ids can't be put in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None
