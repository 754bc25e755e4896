"""Connected components of a link table, by alternating large-star and small-star steps on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is its smallest node.

    Links may repeat, go either way or join a node to itself; a null at either end drops out. Steps are joins and sums by
    node, so a hub is only as large as its distinct links, and skewed joins are split by adaptive execution.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    tally = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    edges = durable(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(high.alias("u"), low.alias("v")).distinct())
    first, before = edges, tally(edges)
    while True:
        # Large star: every neighbour above u goes to the smallest of u and its neighbours.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every neighbour not above u, and u itself, goes to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        near = large.join(least, F.col("u") == F.col("k"))
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        after = durable(small)
        # Stars are stable: each node points to one smallest node, which points nowhere.
        now = tally(after)
        if now == before:
            roots = after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            alone = first.filter("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
            own = after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
            return own.union(alone.join(own, "node", "left_anti")).distinct()
        edges, before = after, now
