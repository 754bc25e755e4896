"""Rules derived per entity from weighed measurements and literature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import policy
from tidemark.functions.rules import route
from tidemark.functions.scalars import significant
from tidemark.operators.merge import first_ids


def genetic_rules(rows: DataFrame, keys: list[str], p_most: float = policy.GENOME_WIDE) -> DataFrame:
    """Over an entity's significant rows: best p and its phenotype, weights, and the best record (by weight, then id)."""
    rows = rows.filter(significant(F.col("p"), p_most))
    best = F.max_by("record", F.struct("weight", "record"))
    return rows.groupBy(*keys).agg(
        F.min("p").alias("best_p"),
        F.min_by("phenotype", F.struct("p", "record")).alias("phenotype"),
        F.round(F.sum("weight"), 6).alias("weight_total"),
        F.max("weight").alias("best_weight"),
        best.alias("best_record"),
        F.max_by("date", F.struct("weight", "record")).alias("best_date"),
        F.bool_and(F.coalesce("author_reported", F.lit(False))).alias("all_author_reported"),
        F.count("*").alias("records"),
        F.array_sort(F.collect_list("record")).alias("record_ids"),
    )


def essentiality_rules(rows: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Hit fraction over an entity's fitness rows, at least ``least`` of them."""
    out = rows.groupBy(*keys).agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight_total"), F.array_sort(F.collect_list("record")).alias("record_ids")).filter(F.col("n") >= least)
    fraction = F.col("hits") / F.col("n")
    return out.withColumn("fraction", F.round(fraction, 6)).withColumn("pan_essential", fraction >= policy.PAN_ESSENTIAL)


def functional_rules(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the phenotype that aren't associations; on equal weights the earliest record is best."""
    best = F.min_by("record", F.struct((-F.col("weight")).alias("w"), "date", "record"))
    return rows.groupBy(*keys).agg(F.count("*").alias("records"), F.count_distinct("system").alias("systems"), F.round(F.sum("weight"), 6).alias("weight_total"), F.max("weight").alias("best_weight"), best.alias("best_record"), F.min_by("date", F.struct((-F.col("weight")).alias("w"), "date", "record")).alias("best_date"), F.array_sort(F.collect_list("record")).alias("record_ids"))


def literature_rules(publications: DataFrame, keys: list[str]) -> DataFrame:
    """Publications per entity, of the phenotype's tier and in all; weight 0.20 each and 0.05 each of the others."""
    out = publications.groupBy(*keys).agg(F.count("*").alias("publications"), F.count_if("tier").alias("tier_publications"), F.min("date").alias("earliest"))
    return out.withColumn("weight", F.round(0.20 * F.col("tier_publications") + 0.05 * (F.col("publications") - F.col("tier_publications")), 6))


def earliest(rows: DataFrame, keys: list[str], most: int = policy.LITERATURE_CAP) -> DataFrame:
    """An entity's first records by date and id (the cap is the rule's own; counts elsewhere stay whole)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("date", "record"))
    return rows.withColumn("k", place).filter(F.col("k") <= most)


def literature_evidence(publications: DataFrame, keys: list[str], most: int = policy.LITERATURE_CAP) -> DataFrame:
    """The tier's publications if an entity has any, else all, the earliest of them.

    The earliest of the tier and of the others are found apart, each cut to ``most`` in every part before the shuffle, so no
    task takes all publications of an entity; the tier's come first in what is left.
    """
    tiered = publications.withColumn("_other", ~F.coalesce("tier", F.lit(False)))
    first = earliest(tiered, [*keys, "_other"], most).drop("k")
    has = F.min("_other").over(Window.partitionBy(*keys))  # at most twice ``most`` rows of an entity
    return earliest(first.withColumn("_has", ~has).filter(~F.col("_has") | ~F.col("_other")).drop("_has", "_other"), keys, most)


def best_measurement(genetic: DataFrame, functional: DataFrame, keys: list[str]) -> DataFrame:
    """The larger best weight of the two rule kinds; the genetic one on ties."""
    both = genetic.select(*keys, "best_weight", "best_record", "best_date", F.lit(0).alias("kind")).unionByName(functional.select(*keys, "best_weight", "best_record", "best_date", F.lit(1).alias("kind")))
    top = F.min_by(F.struct("best_weight", "best_record", "best_date", "kind"), F.struct(-F.col("best_weight"), F.col("kind")))
    return both.groupBy(*keys).agg(top.alias("top")).select(*keys, "top.*")


def composition(edges: DataFrame, best: DataFrame, measured: DataFrame | None, keys: list[str] | None = None) -> DataFrame:
    """For subjects without a measurement of their own, the strongest weight a partner transfers (ties: earliest edge).

    ``edges``: src, dst, date, id; ``best``: entity, best_weight, best_record, best_date; ``measured``: entity, or None to let
    every subject have its route. All with ``keys``, which lead the joins.
    """
    keys = keys or []
    if measured is not None:
        edges = edges.join(measured.select(*keys, F.col("entity").alias("src")).distinct(), [*keys, "src"], "left_anti")
    found = edges.join(best.select(*keys, F.col("entity").alias("dst"), "best_weight", "best_record", "best_date"), [*keys, "dst"])
    share = F.col("best_weight").cast("decimal(18,6)") * F.lit(policy.COMPOSITION_DISCOUNT).cast("decimal(6,4)")  # exact, as weights have six places
    found = found.withColumn("transferred", F.round(share, 6).cast("double"))
    pick = F.min_by(F.struct("dst", "transferred", "date", "best_record", "best_date"), F.struct(-F.col("transferred"), F.col("date"), F.col("id")))
    return found.groupBy(*keys, "src").agg(pick.alias("x")).select(*keys, F.col("src").alias("entity"), F.col("x.dst").alias("partner"), "x.transferred", "x.date", "x.best_record", "x.best_date")


def modality_rules(entities: DataFrame, essential: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The route of each entity (family, locus, raises, cis_element), with what the essentiality rules say of it."""
    keys = [*(keys or []), "entity"]
    out = entities.join(essential.select(*keys, "pan_essential"), keys, "left")
    call = route(F.col("family"), F.col("locus"), F.col("pan_essential"), F.col("raises"), F.col("cis_element"))
    return out.withColumn("call", call).select(*keys, "call.*")


def modality_support(records: DataFrame, routes: DataFrame, keys: list[str] | None = None, most: int = 50) -> DataFrame:
    """A rule row per entity that any other rule is about: keys, entity, rule_id, kind, direction, weight, route and the first
    ``most`` distinct record ids of those rules. An entity whose rules name no record has none. ``records``: keys, entity, record,
    a row per record of a rule."""
    by = [*(keys or []), "entity"]
    ids = first_ids(records, by, most)
    named = F.concat(F.lit("rule:modality:"), F.col("entity").cast("string")).alias("rule_id")
    return ids.join(routes, by).select(*by, named, F.lit("modality").alias("kind"), F.lit("none").alias("direction"), F.lit(0.0).alias("weight"), "route", "record_ids")


def gate(rules: DataFrame, count: Column | None = None) -> DataFrame:
    """Rules with reject_reason, the first failed condition, null for good ones; nothing is dropped here. ``count``: how many
    records a rule has, where it doesn't hold them as an array."""
    reason = (
        F.when(F.coalesce(F.size("records") if count is None else count, F.lit(0)) < 1, "no record")
        .when(F.coalesce(F.trim("statement"), F.lit("")) == "", "blank statement")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence outside 0..1")
        .when(F.col("direction").isNotNull() & F.col("phenotype").isNull(), "direction without phenotype")
        .when((F.coalesce(F.size("subjects"), F.lit(0)) < 1) & (F.col("kind") != "corpus"), "no subject")
        .when(F.col("weight") < 0, "negative weight")
    )
    return rules.withColumn("reject_reason", reason)


def applies(gene: Column, phenotype: Column, system: Column) -> Column:
    """Whether a rule (subjects, phenotype, systems) covers a case; an empty scope covers all."""
    open_ = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    return (open_("subjects") | F.array_contains("subjects", gene)) & (F.col("phenotype").isNull() | (F.col("phenotype") == phenotype)) & (open_("systems") | F.array_contains("systems", system))
