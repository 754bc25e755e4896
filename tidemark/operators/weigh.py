"""What a measurement weighs, from how it was made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import policy
from tidemark.functions.rules import lookup
from tidemark.functions.scalars import significant


def replication_counts(measurements: DataFrame, keys: list[str], replicate: str) -> DataFrame:
    """Distinct publications per entity (feeds a weight, so it is exact)."""
    return measurements.groupBy(*keys).agg(F.countDistinct(replicate).alias("replicates"))


def genetic_support(measurements: DataFrame, keys: list[str], p: str, most: float = policy.GENOME_WIDE) -> DataFrame:
    """Entities with any significant association."""
    return measurements.groupBy(*keys).agg(F.bool_or(significant(F.col(p), most)).alias("supported")).filter("supported").drop("supported")


def directness_of(measurements: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """The phenotype's directness, proxy where it is missing. The vocabulary goes to the measurements: a task per phenotype
    would take all of its rows."""
    return measurements.join(F.broadcast(phenotypes.select("phenotype", F.col("directness").alias("d"))), "phenotype", "left").withColumn("directness", F.coalesce("d", F.lit("proxy"))).drop("d")


def weight(system: Column, perturbation: Column, directness: Column, assay: Column, replicates: Column, supported: Column, author_reported: Column, tables: dict[str, dict] | None = None) -> Column:
    """Six factors multiplied, a penalty for author-reported genes, held to [0.01, 2], rounded to 6."""
    t = {"system": policy.SYSTEM_WEIGHTS, "perturbation": policy.PERTURBATION_WEIGHTS, "directness": policy.DIRECTNESS_WEIGHTS, "assay": policy.ASSAY_MODIFIERS} | (tables or {})
    product = lookup(t["system"], system, policy.SYSTEM_WEIGHTS["cell_free_or_unspecified"])
    product *= lookup(t["perturbation"], perturbation, policy.PERTURBATION_WEIGHTS["unspecified"])
    product *= lookup(t["directness"], directness, policy.DIRECTNESS_WEIGHTS["proxy"])
    product *= lookup(policy.REPLICATION, F.coalesce(replicates, F.lit(0)).cast("int"), policy.REPLICATION_CAP)
    product *= F.when(F.coalesce(supported, F.lit(False)), policy.GENETIC_BONUS).otherwise(1.0)
    product *= lookup(t["assay"], assay, policy.UNKNOWN_ASSAY)
    product *= F.when(F.coalesce(author_reported, F.lit(False)), policy.AUTHOR_REPORTED_PENALTY).otherwise(1.0)
    return F.round(F.least(F.greatest(product, F.lit(policy.LEAST_WEIGHT)), F.lit(policy.MOST_WEIGHT)), 6)


def weigh(measurements: DataFrame, keys: list[str], tables: dict[str, dict] | None = None, uniform: bool = False, p_most: float = policy.GENOME_WIDE) -> DataFrame:
    """J12 over a table: entity keys, pmid, p, assay, system, perturbation, directness, author_reported -> weight.

    Both statistics of an entity come from one grouping, joined back on its keys. J13: ``uniform`` gives every row 1.0.
    """
    if uniform:
        return measurements.withColumn("weight", F.lit(1.0))
    stats = measurements.groupBy(*keys).agg(F.countDistinct("pmid").alias("replicates"), F.bool_or(significant(F.col("p"), p_most)).alias("supported"))
    out = measurements.join(stats, keys)
    c = F.col
    return out.withColumn("weight", weight(c("system"), c("perturbation"), c("directness"), c("assay"), c("replicates"), c("supported"), c("author_reported"), tables))
