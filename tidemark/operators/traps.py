"""Decoys that a forecast must get right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import policy
from tidemark.operators.merge import first_ids


def association_traps(associations: DataFrame, established: DataFrame, most_p: float = policy.GENOME_WIDE, ids: int = 10) -> DataFrame:
    """Entities with a strong association that were never established; the first ``ids`` record ids are named."""
    rows = associations.filter((F.col("p") > 0) & (F.col("p") < most_p)).join(established.select("entity"), "entity", "left_anti")
    out = rows.groupBy("entity").agg(F.min("p").alias("best_p"), F.count("*").alias("n"), F.count_distinct("accession").alias("accessions"))
    out = out.join(first_ids(rows, ["entity"], ids).withColumnRenamed("record_ids", "records"), "entity")
    return out.withColumn("answer", F.lit("reject"))


def essential_traps(effects: DataFrame, least_lines: int = 100, least_share: float = policy.PAN_ESSENTIAL, most: float = policy.ESSENTIAL_EFFECT, ids: int = 10) -> DataFrame:
    """A10: entities essential nearly everywhere, over the full store, with the numbers that say so and the first ``ids``
    record ids, as text (``effects``: entity, effect, record)."""
    out = effects.groupBy("entity").agg(F.count("*").alias("lines"), F.count_if(F.col("effect") <= most).alias("essential_lines"), F.round(F.avg("effect"), 6).alias("mean_effect"))
    found = out.filter((F.col("lines") >= least_lines) & (F.col("essential_lines") >= least_share * F.col("lines"))).withColumn("answer", F.lit("reject"))
    found = found.withColumn("fraction", F.round(F.col("essential_lines") / F.col("lines"), 4))
    if "record" not in effects.columns:
        return found
    named = first_ids(effects.join(found.select("entity"), "entity", "left_semi"), ["entity"], ids)
    return found.join(named.withColumnRenamed("record_ids", "records"), "entity", "left")


def evidence_counts(entities: DataFrame, publications: DataFrame, measurements: DataFrame) -> DataFrame:
    """Per entity the tier's publications that name it (``matched`` array) and its measurements of the phenotype."""
    p = publications.filter("tier").select(F.explode(F.array_distinct("matched")).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("publications"))
    m = measurements.groupBy("entity").agg(F.count("*").alias("measurements"))
    return entities.join(p, "symbol", "left").join(m, "entity", "left").fillna(0, ["publications", "measurements"])


def postdates_traps(established: DataFrame, counts: DataFrame, cutoff: str, most_publications: int = 3) -> DataFrame:
    """Entities established on or after the cutoff with almost no evidence before it; days after the cutoff."""
    day = F.lit(cutoff).cast("date")
    late = established.filter(F.col("established") >= day).withColumn("days_after", F.datediff("established", day))
    out = late.join(counts.select("entity", "publications", "measurements"), "entity", "left").fillna(0, ["publications", "measurements"])
    return out.filter((F.col("publications") < most_publications) & (F.col("measurements") == 0)).withColumn("answer", F.lit("refuse"))


def plant(associations: DataFrame, established: DataFrame, effects: DataFrame, dated: DataFrame, counts: DataFrame, cutoff: str, most_p: float = policy.GENOME_WIDE, least_lines: int = 100, most_effect: float = policy.ESSENTIAL_EFFECT) -> DataFrame:
    """The three families as one table: entity, kind, answer, the record ids that the trap names (as text, ten at most) and
    the numbers it quotes (name to value). A trap about what comes later names no record: there is none before the cutoff."""
    none = F.array().cast("array<string>")
    quoted = lambda *names: F.map_from_entries(F.array(*[F.struct(F.lit(n), F.col(n).cast("double")) for n in names]))
    tables = (
        ("association", association_traps(associations, established, most_p), F.col("records").cast("array<string>"), quoted("best_p", "n", "accessions")),
        ("essential", essential_traps(effects, least_lines, most=most_effect), F.coalesce("records", none), quoted("lines", "essential_lines", "fraction", "mean_effect")),
        ("postdates_cutoff", postdates_traps(dated, counts, cutoff), none, quoted("days_after", "publications", "measurements")),
    )
    rows = [t.select("entity", F.lit(kind).alias("kind"), "answer", records.alias("records"), numbers.alias("numbers")) for kind, t, records, numbers in tables]
    return rows[0].union(rows[1]).union(rows[2])


def alias_probes(entities: DataFrame, each: int = 2) -> DataFrame:
    """The first ``each`` aliases, withdrawn symbols and informal names of every entity, as (name, expected)."""
    empty = F.array().cast("array<string>")
    names = F.concat(*[F.slice(F.coalesce(c, empty), 1, each) for c in ("aliases", "previous", "informal")])
    return entities.select(F.explode(F.array_distinct(names)).alias("name"), F.col("id").alias("expected"))
