"""Walks over the edge table and per-entity lookups in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbors(edges: DataFrame, nodes: DataFrame, starts: DataFrame, kind: str | None = None) -> DataFrame:
    """Nodes that the starts' edges lead to. ``starts``: start."""
    e = edges.filter(F.col("type") == kind) if kind else edges
    e = e.select("src", "dst", F.col("type").alias("edge_type"))
    return starts.join(e, F.col("start") == F.col("src")).join(nodes, F.col("dst") == F.col("id")).select("start", "edge_type", "id", "effective_date")


def chains(edges: DataFrame, starts: DataFrame, depth: int = 4) -> DataFrame:
    """A row per path of up to ``depth`` edges that visits no node twice: start, src, dst, depth."""
    e = edges.select(F.col("src").alias("e_src"), F.col("dst").alias("e_dst"))
    step = starts.select("start", F.col("start").alias("at"), F.array("start").alias("path"))
    out = None
    for d in range(1, depth + 1):
        step = step.join(e, (F.col("at") == F.col("e_src")) & ~F.array_contains("path", F.col("e_dst"))).select("start", F.col("at").alias("src"), F.col("e_dst").alias("at"), F.array_append("path", F.col("e_dst")).alias("path"))
        row = step.select("start", "src", F.col("at").alias("dst"), F.lit(d).alias("depth"))
        out = row if out is None else out.union(row)
    return out


def provenance(edges: DataFrame, starts: DataFrame, forward: tuple[str, ...], depth: int = 4) -> DataFrame:
    """Distinct (start, id, depth) on walks backwards over any edge and forwards over the ``forward`` types.

    The frontier is made distinct at each step; a start is its own at depth 0.
    """
    back = edges.select(F.col("dst").alias("from"), F.col("src").alias("to"))
    ahead = edges.filter(F.col("type").isin(*forward)).select(F.col("src").alias("from"), F.col("dst").alias("to"))
    moves = back.union(ahead).distinct()
    frontier = starts.select("start", F.col("start").alias("id")).distinct()
    out = frontier.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        frontier = frontier.join(moves, F.col("id") == F.col("from")).select("start", F.col("to").alias("id")).distinct()
        out = out.union(frontier.withColumn("depth", F.lit(d)))
    return out


def listing(nodes: DataFrame, kind: str, limit: int) -> DataFrame:
    """The first ``limit`` nodes of a type by date and id."""
    return nodes.filter(F.col("type") == kind).orderBy("effective_date", "id").limit(limit)


def _first_and_total(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each key with their place, and how many rows it has. Each part is cut to a key's first rows
    before the shuffle and counts its rows by key, so no task takes all rows of one key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = rows.withColumn("place", place).filter(F.col("place") <= most)
    totals = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("total"))
    return first.join(totals, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def latest(rows: DataFrame, key: str, date: str, record: str, most: int = 20) -> DataFrame:
    """The newest ``most`` rows of each entity, with how many it has in all."""
    return _first_and_total(rows, key, [F.desc(date), F.col(record)], most)


def partners(edges: DataFrame, most: int = 20) -> DataFrame:
    """Distinct (partner, group) in either direction, in order, the first ``most``, with the total."""
    both = edges.select(F.col("src").alias("entity"), F.col("dst").alias("partner"), "group").union(edges.select("dst", "src", "group")).distinct()
    return _first_and_total(both, "entity", [F.col("partner"), F.col("group")], most)


def by_publication_count(entities: DataFrame, publications: DataFrame) -> DataFrame:
    """Entities by the number of publications, zero counts kept."""
    n = publications.groupBy("entity").agg(F.count("*").alias("publications"))
    return entities.join(n, "entity", "left").fillna(0, ["publications"]).orderBy(F.desc("publications"), "symbol")


def measurements_by_assay(measurements: DataFrame) -> DataFrame:
    """Counts per entity and assay."""
    return measurements.groupBy("entity", "assay").agg(F.count("*").alias("n"))
