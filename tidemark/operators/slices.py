"""As-of slices of a dated graph and their checks.

A graph is two tables: nodes (id, effective_date, ...) and edges (id, src, dst, effective_date, ...). All cutoffs are cut
in one job; ``cutoff`` is then a column and leads every key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cutoff_table(like: DataFrame, cutoffs: list[str]) -> DataFrame:
    return like.sparkSession.createDataFrame([(c,) for c in sorted(set(cutoffs))], "cutoff string").select(F.col("cutoff").cast("date"))


def asof(rows: DataFrame, cutoffs: list[str]) -> DataFrame:
    """Each row once per cutoff that its effective_date lies strictly before.

    The list of cutoffs becomes an array literal, so the range join is an explode in the scan's stage, behind a filter on
    the last cutoff that reaches the files.
    """
    days = sorted(set(cutoffs))
    after = F.filter(F.array(*[F.lit(c).cast("date") for c in days]), lambda c: c > F.col("effective_date"))
    return rows.filter(F.col("effective_date") < F.lit(days[-1]).cast("date")).withColumn("cutoff", F.explode(after))


def drop_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are in the same slice."""
    known = nodes.select("cutoff", "id")
    for end in ("src", "dst"):
        k = known.select(F.col("cutoff").alias("k_cutoff"), F.col("id").alias("k_id"))
        edges = edges.join(k, (F.col("cutoff") == F.col("k_cutoff")) & (F.col(end) == F.col("k_id")), "left_semi")
    return edges


def visible_edges(nodes: DataFrame, edges: DataFrame, cutoffs: list[str]) -> DataFrame:
    """J07 for all cutoffs at once: ``edges`` (uncut) with visible_from, the latest of their own date and both ends', once per
    cutoff after it. Each edge meets each end once, however many cutoffs there are; edges without an end drop out."""
    for end in ("src", "dst"):
        dates = nodes.select(F.col("id").alias(f"{end}_id"), F.col("effective_date").alias(f"{end}_date"))
        edges = edges.join(dates, F.col(end) == F.col(f"{end}_id")).drop(f"{end}_id")
    own = edges.withColumn("visible_from", F.greatest("effective_date", "src_date", "dst_date")).drop("src_date", "dst_date")
    return asof(own.withColumnRenamed("effective_date", "own_date").withColumnRenamed("visible_from", "effective_date"), cutoffs).withColumnRenamed("effective_date", "visible_from").withColumnRenamed("own_date", "effective_date")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that isn't a node, and which end that is, for the exclusion table."""
    known = nodes.select(F.col("id").alias("k_id"))
    lost = lambda end: edges.join(known, F.col(end) == F.col("k_id"), "left_anti").select("id", *[F.lit(e == end).alias(e) for e in ("dst", "src")])
    # two flags, which Spark folds in hashed rows of fixed size; a set per edge would be an object each, and a sort of all
    ends = lost("src").union(lost("dst")).groupBy("id").agg(F.bool_or("dst").alias("dst"), F.bool_or("src").alias("src"))
    return ends.select("id", F.concat_ws("+", *[F.when(F.col(e), e) for e in ("dst", "src")]).alias("missing"))


def mask(nodes: DataFrame, edges: DataFrame, hidden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the ids in ``hidden`` (id) and without edges that touch them."""
    h = hidden.select(F.col("id").alias("h_id")).distinct()
    nodes = nodes.join(h, F.col("id") == F.col("h_id"), "left_anti")
    for end in ("src", "dst"):
        edges = edges.join(h, F.col(end) == F.col("h_id"), "left_anti")
    return nodes, edges


def manifest(nodes: DataFrame, edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Per cutoff nodes, edges, dangling edges, and the latest effective date of the slice."""
    rows = nodes.select("cutoff", "effective_date", F.lit(1).alias("n"), F.lit(0).alias("e"), F.lit(0).alias("k"))
    rows = rows.unionByName(edges.select("cutoff", F.lit(None).cast("date").alias("effective_date"), F.lit(0).alias("n"), F.lit(1).alias("e"), F.lit(0).alias("k")))
    rows = rows.unionByName(kept.select("cutoff", "effective_date", F.lit(0).alias("n"), F.lit(0).alias("e"), F.lit(1).alias("k")))
    return rows.groupBy("cutoff").agg(F.sum("n").alias("nodes"), F.sum("k").alias("edges"), F.sum(F.col("e") - F.col("k")).alias("dangling"), F.max("effective_date").alias("max_effective_date"))


def leaks(sliced: DataFrame) -> DataFrame:
    """Rows of a slice that aren't strictly before its cutoff; must be empty."""
    return sliced.filter(F.col("effective_date") >= F.col("cutoff"))


def not_in_later(sliced: DataFrame, earlier: str, later: str) -> DataFrame:
    """Ids of the earlier slice that the later one lacks; must be empty."""
    at = lambda c: sliced.filter(F.col("cutoff") == F.lit(c).cast("date")).select("id")
    return at(earlier).exceptAll(at(later))
