"""Merging, upserts, unions and set checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def last_write(rows: DataFrame, keys: list[str], load_order: str) -> DataFrame:
    """Upserts, the later row replaces the earlier."""
    return first_by(rows, keys, F.desc(load_order))


def union_all(*tables: DataFrame) -> DataFrame:
    """By column name; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def asked_units(*tables: DataFrame) -> DataFrame:
    """Every unit that any table names."""
    return reduce(lambda a, b: a.union(b), tables).distinct()


def merge_hits(hits: DataFrame, key: str, gene: str, tier: str, order: str, fields: list[str]) -> DataFrame:
    """One row per record found by several searches: the first hit's fields, all genes and tiers."""
    first = [F.min_by(c, order).alias(c) for c in fields]
    return hits.groupBy(key).agg(*first, F.array_sort(F.collect_set(gene)).alias("genes"), F.array_sort(F.collect_set(tier)).alias("tiers"))


def search_coverage(searches: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """Per search (keys, available) how many records it has, how many came, and whether it was cut short."""
    got = hits.groupBy(*keys).agg(F.count("*").alias("retrieved"))
    return searches.join(got, keys, "left").fillna(0, ["retrieved"]).withColumn("truncated", F.col("available") > F.col("retrieved"))


def missing_references(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Ids that one source names and the other lacks."""
    return wanted.select(key).filter(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")


def attach_license(rows: DataFrame, licenses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the licence of their source, and the sources that have none (must be empty)."""
    return rows.join(licenses, "source"), rows.select("source").distinct().join(licenses, "source", "left_anti")


def current_vectors(vectors: DataFrame, titles: DataFrame) -> DataFrame:
    """Vectors made for the title that a record has now."""
    return vectors.join(titles, ["id", "title"], "left_semi")


def vector_backlog(titles: DataFrame, vectors: DataFrame) -> DataFrame:
    """Titles with no vector, or one made for another title."""
    return titles.join(vectors.select("id", "title"), ["id", "title"], "left_anti")


def read_back(ranked: DataFrame, rows: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The rows of ranked ids, and the ids that aren't there (a leak)."""
    return ranked.join(rows, key), ranked.join(rows.select(key), key, "left_anti")


def report(rows: DataFrame, *dimensions: str) -> DataFrame:
    """Counts by each dimension and in all, from one pass: dimension, value, n."""
    sets = [[d] for d in dimensions] + [[]]
    out = rows.groupingSets(sets, *dimensions).agg(F.count("*").alias("n"), *[F.grouping(d).alias(f"g_{d}") for d in dimensions])
    name = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.lit(d)) for d in dimensions], F.lit("all"))
    return out.select(name.alias("dimension"), F.coalesce(*[F.col(d).cast("string") for d in dimensions]).alias("value"), "n")


def first_use(rows: DataFrame, key: str, date: str) -> DataFrame:
    """The first date of each key."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(date).alias("first_use"))


def first_name(rows: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """The first name of each key in an order."""
    return rows.groupBy(key).agg(F.min_by(name, order).alias(name))


def merge_reports(*reports: DataFrame) -> DataFrame:
    """Reports (counter, n, findings array) as one: counters summed, findings one after another in order."""
    every = union_all(*[r.withColumn("report", F.lit(i)) for i, r in enumerate(reports)])
    found = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("report", "findings"))), lambda x: x["findings"]))
    return every.groupBy("counter").agg(F.sum("n").alias("n"), found.alias("findings"))


def difference(candidates: DataFrame, established: DataFrame) -> DataFrame:
    """Distinct candidates that aren't established."""
    return candidates.subtract(established)


def first_ids(rows: DataFrame, keys: list[str], most: int, record: str = "record") -> DataFrame:
    """keys and record_ids: the first ``most`` distinct ids of each key, sorted as text. Parts are cut to so many ids of a key
    before the shuffle, so no row holds more, however many records a key has."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("record_id"))
    ids = rows.select(*keys, F.col(record).cast("string").alias("record_id")).distinct().withColumn("_place", place).filter(F.col("_place") <= most)
    return ids.groupBy(*keys).agg(F.array_sort(F.collect_list("record_id")).alias("record_ids"))


def loaded_rates(available: DataFrame, loaded: DataFrame, spurious: DataFrame) -> DataFrame:
    """Source, available, loaded, rate (of those available, 0 without any) and spurious. ``available``: source, n; ``loaded``
    and ``spurious``: a row each, with its source. A source that only one of them knows has zeros for the rest."""
    count = lambda rows, name: rows.groupBy("source").agg(F.count("*").alias(name))
    out = available.groupBy("source").agg(F.sum("n").alias("available")).join(count(loaded, "loaded"), "source", "full").join(count(spurious, "spurious"), "source", "full").fillna(0)
    return out.withColumn("rate", F.coalesce(F.round(F.col("loaded") / F.nullif("available", F.lit(0)), 6), F.lit(0.0)))


def spurious_rows(nodes: DataFrame) -> DataFrame:
    """Nodes that no source record backs, with why: no source id or licence, or a measurement without a value."""
    bare = F.lit("missing provenance")
    why = F.filter(F.array(F.when((F.coalesce("source_id", F.lit("")) == "") | (F.coalesce("license", F.lit("")) == ""), bare), F.when((F.col("type") == "Measurement") & F.col("value").isNull(), "measurement with no value")), lambda x: x.isNotNull())
    return nodes.withColumn("problem", F.explode(why))
