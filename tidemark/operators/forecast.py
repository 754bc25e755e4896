"""Forecasts: what is established, what is reported or refused, and the two rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import policy
from tidemark.functions.rules import refusal_reason, reportable
from tidemark.sources.readers import scratch_folder


def established_before(truth: DataFrame) -> Column:
    """Strictly before the cutoff; from the cutoff on it is ground truth."""
    return F.col("established") < F.col("cutoff")


def decide(claims: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Claims with outcome established, forecast or refused, and why. ``truth``: entity, established."""
    out = claims.join(truth.select("entity", "established"), "entity", "left")
    known = F.coalesce(F.col("established") < F.col("cutoff"), F.lit(False)) if "cutoff" in keys else F.col("established").isNotNull()
    good = reportable(F.col("confidence"), F.col("max_support"), F.col("publications"), F.col("max_composition"))
    outcome = F.when(known, "established").when(good, "forecast").otherwise("refused")
    return out.withColumn("outcome", outcome).withColumn("reason", F.when(F.col("outcome") == "refused", refusal_reason(F.col("confidence"), F.col("max_support"))))


def ranked_by(items: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``items`` with their place (from 1) in a total order within each key, without bringing a key's rows to one task.

    Rows are range-sorted by key and order; each part numbers its own rows, and the counts of the parts before it (a small
    table: parts times keys) are added.
    """
    ranged = reliable(items.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return ranged.join(ahead, [*keys, "_part"]).withColumn(name, (F.col("_ahead") + within).cast("int")).drop("_part", "_ahead")


def reliable(table: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder and read from there, so that all that follows sees the same rows and parts."""
    context = table.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch_folder(table.sparkSession, "checkpoints"))
    return table.checkpoint()


def stored(table: DataFrame) -> DataFrame:
    """As ``reliable``, but in columns: each of many readers opens only those that it needs. Parts aren't kept as they were."""
    path = scratch_folder(table.sparkSession, "stored")
    table.write.parquet(path)
    return table.sparkSession.read.parquet(path)


def rank_two_ways(items: DataFrame, keys: list[str], route_weight: Column) -> DataFrame:
    """By confidence, and by confidence times the weight of the route; ties by confidence, then symbol."""
    items = items.withColumn("cost_score", F.round(F.col("confidence") * route_weight, 6))
    first = ranked_by(items, keys, [F.desc("confidence"), F.col("symbol")], "rank")
    return ranked_by(first, keys, [F.desc("cost_score"), F.desc("confidence"), F.col("symbol")], "cost_rank")


def first_of(rows: DataFrame, keys: list[str], most: int, *order: str) -> DataFrame:
    """The first ``most`` rows of each key; Spark cuts to them in each part before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")


def rank_answers(answers: DataFrame, keys: list[str]) -> DataFrame:
    """By the confidence given, equal ones in the order given. ``answers``: keys, position, confidence."""
    return answers.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), "position")))


def valid_answers(answers: DataFrame, schema: str, keys: list[str]) -> DataFrame:
    """Answer JSON parsed (``schema`` has claims: gene_symbol, confidence), with status ok or the first thing wrong with it."""
    out = answers.withColumn("parsed", F.from_json("answer", schema, {"mode": "PERMISSIVE"}))
    genes = F.transform("parsed.claims", lambda c: F.upper(F.trim(c["gene_symbol"])))
    status = (
        F.when(F.col("parsed").isNull() | F.col("parsed.claims").isNull(), "not the schema")
        .when(F.exists("parsed.claims", lambda c: c["confidence"].isNull() | ~c["confidence"].between(0, 1)), "confidence outside 0..1")
        .when(F.size(F.array_distinct(genes)) < F.size(genes), "two answers for a gene")
        .otherwise("ok")
    )
    return out.withColumn("status", status)


def flat_baseline(publications: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """Confidence from publication counts alone, relative to the largest count of the slice (1 if that is 0)."""
    counts = publications.groupBy(*keys, entity).agg(F.count("*").alias("publications"), F.count_if("tier").alias("tier_publications"))
    top = counts.groupBy(*keys).agg(F.max("tier_publications").alias("top"))
    return counts.join(top, keys).withColumn("confidence", F.round(F.col("tier_publications") / F.greatest(F.col("top"), F.lit(1)), 6)).drop("top")


def history(verdicts: DataFrame) -> DataFrame:
    """Each entity's verdict by cutoff, the one before, and whether it changed."""
    w = Window.partitionBy("entity").orderBy("cutoff")
    return verdicts.withColumn("before", F.lag("verdict").over(w)).withColumn("changed", F.coalesce(F.col("before") != F.col("verdict"), F.lit(False)))


def ranked_claims(claims: DataFrame, outcome: str = "forecast") -> DataFrame:
    """Reported (or refused) claims, best first."""
    return claims.filter(F.col("outcome") == outcome).orderBy(F.desc("confidence"), "symbol")


ROUTES = policy.ROUTE_WEIGHTS
