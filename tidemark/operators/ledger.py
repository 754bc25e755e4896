"""Evidence increments, the running ledger of each claim, and its roll-up."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import policy
from tidemark.functions.scalars import from_log_odds
from tidemark.operators.scans import running
from tidemark.sources import runs

PRIOR = math.log(policy.PRIOR_CONFIDENCE / (1 - policy.PRIOR_CONFIDENCE))


def literature_weight(k: Column) -> Column:
    """The k-th publication adds ln(1+k) - ln(k), a quarter of it outside the tier; n of them ln(1+n)."""
    step = (F.log1p(k) - F.log(k)) * policy.LITERATURE_SCALE * F.when(F.col("tier"), 1.0).otherwise(policy.OTHER_LITERATURE)
    return step / policy.EVIDENCE_STRENGTH


def literature_increments(publications: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Publications with their place k by date and id, weight and direction."""
    rows = running(publications, keys, ["date", "record"], {"k": F.lit(1)}, parts).drop("k_total").withColumn("k", (F.col("k") + 1).cast("int"))
    return rows.withColumns({"weight": literature_weight(F.col("k")), "direction": F.lit(1)})


def essentiality_increments(rows: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """The hits of pan-essential entities, harmonic shares that sum to 1.20 times the hit fraction, downwards.

    ``rows``: keys, date, record, hit (null: unknown, neither a hit nor counted).
    """
    counted = running(rows, keys, ["date", "record"], {"k": F.col("hit").cast("int"), "n": F.when(F.col("hit").isNotNull(), 1)}, parts)
    fraction, n = F.col("k_total") / F.nullif("n_total", F.lit(0)), F.col("k_total")
    k = F.col("k") + 1  # hits before it, and itself
    share = (F.log1p(k) - F.log(k)) / F.log1p(n)
    found = counted.filter(F.col("hit") & (fraction >= policy.PAN_ESSENTIAL))
    weight = policy.ESSENTIALITY_CEILING * F.col("fraction") * share / policy.EVIDENCE_STRENGTH
    found = found.withColumns({"fraction": fraction}).withColumns({"weight": weight, "direction": F.lit(-1)})
    return found.withColumns({"k": k.cast("int"), "n": n}).drop("k_total", "n_total")


def revise(evidence: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Each claim's log-odds in the order of date and record: seq, delta, prior and posterior, and their confidences."""
    delta = F.col("direction") * F.col("weight") * policy.EVIDENCE_STRENGTH
    out = running(evidence.withColumn("delta", delta), keys, ["date", "record"], {"seq": F.lit(1), "prior": F.col("delta")}, parts)
    out = out.withColumns({"seq": (F.col("seq") + 1).cast("int"), "prior": PRIOR + F.col("prior")}).drop("seq_total", "prior_total")
    out = out.withColumn("posterior", F.col("prior") + F.coalesce("delta", F.lit(0.0)))
    return out.withColumns({"prior_confidence": from_log_odds(F.col("prior")), "posterior_confidence": from_log_odds(F.col("posterior"))})


def roll_up(evidence: DataFrame, keys: list[str], flat: bool = False) -> DataFrame:
    """Each claim's final state. The sum of increments is the end of the ledger, so no window is needed.

    ``kind`` tells where evidence comes from: literature doesn't count as a supporting measurement, composition has a bar of
    its own, and only publications of the tier count as such. supporting and contradicting are the record ids in the order of
    the ledger. ``flat``: the ablation that leaves every claim at its prior.
    """
    in_order = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("date", "record")))), lambda x: x["record"])
    delta = F.col("direction") * F.col("weight") * policy.EVIDENCE_STRENGTH
    up = F.col("direction") > 0
    total = F.lit(PRIOR) if flat else PRIOR + F.sum(delta)
    return evidence.groupBy(*keys).agg(
        F.round(total, 6).alias("log_odds"),
        F.round(from_log_odds(total), 6).alias("confidence"),
        F.count("*").alias("evidence"),
        F.max(F.when(up & F.col("kind").isin("measurement", "genetic"), F.col("weight"))).alias("max_support"),
        F.max(F.when(up & (F.col("kind") == "composition"), F.col("weight"))).alias("max_composition"),
        F.count_if((F.col("kind") == "literature") & F.col("tier")).alias("publications"),
        in_order(up).alias("supporting"),
        in_order(F.col("direction") < 0).alias("contradicting"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def roll_up_slots(evidence: DataFrame, keys: list[str], slots: dict[str, tuple[Column | None, Column]]) -> DataFrame:
    """A08 for many ablations in one pass: each slot (name: weight, condition) folds its own sums over the same rows, so that
    scans and shuffles don't multiply. A slot without a weight leaves every claim at its prior; a claim whose evidence a slot
    leaves out stays there, too. Gives keys, ablation, log_odds, confidence, evidence, max_support, max_composition, publications."""
    measured, up = F.col("kind").isin("measurement", "genetic"), F.col("direction") > 0
    folds, states = [], []
    for i, (name, (weight, keep)) in enumerate(slots.items()):
        own = F.col("weight") if weight is None else weight
        when = lambda test, c: F.when(F.coalesce(test, F.lit(False)), c)
        parts = {
            "sum": F.sum(when(keep, F.col("direction") * own * policy.EVIDENCE_STRENGTH)),
            "evidence": F.count_if(keep),
            "max_support": F.max(when(keep & up & measured, own)),
            "max_composition": F.max(when(keep & up & (F.col("kind") == "composition"), own)),
            "publications": F.count_if(keep & (F.col("kind") == "literature") & F.col("tier")),
        }
        folds += [c.alias(f"{k}_{i}") for k, c in parts.items()]
        total = F.lit(PRIOR) if weight is None else PRIOR + F.coalesce(F.col(f"sum_{i}"), F.lit(0.0))
        rest = [F.col(f"{k}_{i}").alias(k) for k in ("evidence", "max_support", "max_composition", "publications")]
        states.append(F.struct(F.lit(name).alias("ablation"), F.round(total, 6).alias("log_odds"), F.round(from_log_odds(total), 6).alias("confidence"), *rest))
    return evidence.groupBy(*keys).agg(*folds).select(*keys, F.explode(F.array(*states)).alias("slot")).select(*keys, "slot.*")


def seed_claims(rules: DataFrame, entities: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One claim per entity that a rule is about and that the slice holds, at the prior, with its route and its number of
    publications of the tier. ``rules``: entity, rule_id, and for the kinds that have them route and tier_publications."""
    keys = [*(keys or []), "entity"]
    known = rules.groupBy(*keys).agg(F.max("route").alias("route"), F.coalesce(F.max("tier_publications"), F.lit(0)).cast("long").alias("publications"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))
    known = known.join(entities.select("entity"), "entity", "left_semi")
    return known.withColumns({"claim": F.concat(F.lit("claim:"), F.col("entity").cast("string")), "prior_confidence": F.lit(policy.PRIOR_CONFIDENCE)})


def append_ledger(ledger: DataFrame, path: str, run_id: str) -> bool:
    """Rows are only ever added, by whole runs, each exactly once: a repeated run changes nothing (False)."""
    return runs.append(ledger, path, run_id)


def read_ledger(spark: SparkSession, path: str, run_id: str | None = None, claim=None) -> DataFrame:
    """The committed rows by claim and seq; an empty (run_id, claim, seq) table if no such run was committed."""
    rows = runs.read(spark, path, run_id)
    if rows is None:
        return spark.createDataFrame([], "run_id string, claim string, seq int")
    return (rows if claim is None else rows.filter(F.col("claim") == claim)).orderBy("claim", "seq")
