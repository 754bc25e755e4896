"""Scoring a forecast."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.forecast import ranked_by

def ground_truth(established: DataFrame, cutoffs: list[str]) -> DataFrame:
    """Entities established on or after each cutoff."""
    days = F.array(*[F.lit(c).cast("date") for c in sorted(set(cutoffs))])
    return established.withColumn("cutoff", F.explode(F.filter(days, lambda c: c <= F.col("established"))))


def ranking_metrics(ranked: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """P@5 and P@10 (always over 5 and 10), reciprocal rank of the first hit, zero without one. ``ranked``: keys, entity, rank."""
    t = truth.select(*[F.col(k).alias(f"t_{k}") for k in keys], F.col("entity").alias("t_entity")).distinct()
    on = F.col("entity") == F.col("t_entity")
    for k in keys:
        on &= F.col(k) == F.col(f"t_{k}")
    # truth per answer shuffles to few bytes, but is too many rows to broadcast
    hit = ranked.join(t.hint("merge"), on, "left").withColumn("hit", F.col("t_entity").isNotNull())
    at = lambda n: (F.count_if(F.col("hit") & (F.col("rank") <= n)) / n)
    first = F.min(F.when(F.col("hit"), F.col("rank")))
    return hit.groupBy(*keys).agg(at(5).alias("p_at_5"), at(10).alias("p_at_10"), F.coalesce(1 / first, F.lit(0.0)).alias("reciprocal_rank"), F.count_if("hit").alias("hits"), F.count("*").alias("ranked"))


def calibration_bins(scored: DataFrame, keys: list[str], bins: int = 5) -> DataFrame:
    """Equal bins [lo, hi), the last closed; n, mean confidence, observed rate; empty bins are zeros. ``scored``: keys, confidence, hit."""
    place = F.least((F.col("confidence") * bins).cast("int"), F.lit(bins - 1))
    found = scored.groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("hit").cast("int")).alias("observed"))
    frame = scored.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(found, [*keys, "bin"], "left").fillna(0, ["n", "mean_confidence", "observed"])


def calibration_error(bins: DataFrame, keys: list[str]) -> DataFrame:
    """The sum over bins of n/N * |mean - observed|."""
    return bins.groupBy(*keys).agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("observed"))) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("ece"))


def trap_outcomes(traps: DataFrame, forecast: DataFrame, keys: list[str]) -> DataFrame:
    """Traps with passed and vacuous. ``traps``: keys, trap, entity, answer; ``forecast``: keys, entity, outcome, rank, cost_rank.

    reject passes unless the entity is in the top ten of either ranking (vacuous if nothing is forecast); refuse passes if it
    is refused or absent; accept passes if it is forecast.
    """
    f = forecast.select(*[F.col(k).alias(f"f_{k}") for k in keys], F.col("entity").alias("f_entity"), "outcome", "rank", "cost_rank")
    on = F.col("entity") == F.col("f_entity")
    for k in keys:
        on &= F.col(k) == F.col(f"f_{k}")
    sizes = forecast.groupBy(*keys).agg(F.count_if(F.col("outcome") == "forecast").alias("forecast_size"))
    out = traps.join(f, on, "left").join(sizes, keys, "left")
    made = F.coalesce(F.col("outcome") == "forecast", F.lit(False))
    top = made & ((F.coalesce("rank", F.lit(99)) <= 10) | (F.coalesce("cost_rank", F.lit(99)) <= 10))
    passed = F.when(F.col("answer") == "reject", ~top).when(F.col("answer") == "refuse", F.coalesce(F.col("outcome") == "refused", F.lit(True))).otherwise(made)
    vacuous = (F.col("answer") == "reject") & (F.coalesce("forecast_size", F.lit(0)) == 0)
    return out.withColumns({"passed": passed, "vacuous": vacuous}).select(*traps.columns, "passed", "vacuous")


def trap_rollup(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Totals by kind. Traps of kind postdates_cutoff test contamination and count when passed; the others test judgement
    and count when passed with something forecast. ``meaningful``: passed and not vacuous, of all."""
    late, good = F.col("kind") == "postdates_cutoff", F.col("passed") & ~F.col("vacuous")
    return outcomes.groupBy(*keys).agg(
        F.count("*").alias("traps"),
        F.count_if("passed").alias("passed"),
        F.count_if(F.col("passed") & F.col("vacuous")).alias("vacuous"),
        F.count_if(good).alias("meaningful"),
        F.count_if(~late).alias("judgement_total"),
        F.count_if(~late & good).alias("judgement"),
        F.count_if(late).alias("contamination_total"),
        F.count_if(late & F.col("passed")).alias("contamination"),
    )


def refusal_accuracy(asked: DataFrame, forecast: DataFrame, truth: DataFrame) -> DataFrame:
    """Of the entities that should be refused, how many were, and how many turned out true. All: entity (and outcome)."""
    refused = forecast.filter(F.col("outcome") == "refused").select("entity").distinct().withColumn("refused", F.lit(True))
    true = truth.select("entity").distinct().withColumn("true", F.lit(True))
    out = asked.select("entity").distinct().join(refused, "entity", "left").join(true, "entity", "left")
    return out.agg(F.count("*").alias("should_refuse"), F.count_if(F.coalesce("refused", F.lit(False))).alias("refused"), F.count_if(F.coalesce("true", F.lit(False))).alias("turned_out_true"))


def cost_lens(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose ranks differ, the first route of either ranking, and the best rank of a small molecule."""
    first = lambda rank: F.max(F.when(F.col(rank) == 1, F.col("route")))
    return ranked.groupBy(*keys).agg(F.count_if(F.col("rank") != F.col("cost_rank")).alias("moved"), first("rank").alias("first_route"), first("cost_rank").alias("first_cost_route"), F.min(F.when(F.col("route") == "SMALL_MOLECULE", F.col("cost_rank"))).alias("small_molecule_rank"))


def trace_records(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """Record ids that objects name against the nodes: objects, ids, untraceable ids, ids without a licence. An object that
    names none has no untraceable id. ``named``: object, record_ids."""
    ids = named.select("object", F.explode_outer("record_ids").alias("record_id"))
    found = ids.join(nodes.select(F.col("id").alias("n_id"), "license"), F.col("record_id") == F.col("n_id"), "left")
    return found.agg(F.count_distinct("object").alias("objects"), F.count("record_id").alias("ids"), F.count_if(F.col("record_id").isNotNull() & F.col("n_id").isNull()).alias("untraceable"), F.count_if(F.col("n_id").isNotNull() & F.col("license").isNull()).alias("unlicensed"))


def classify_citations(cited: DataFrame, context: DataFrame, sliced: DataFrame, store: DataFrame, shown: list[str] | None = None) -> DataFrame:
    """Each citation (claim, record_id) as in_context, out_of_context, post_cutoff or fabricated. A row of the slice is in
    context if it was shown with the same claim, or with the same ``shown`` columns."""
    out, by = cited, [*(["claim"] if shown is None else shown), "record_id"]
    for name, table, keys in (("in_context", context.select(*by).distinct(), by), ("in_slice", sliced.select("record_id").distinct(), ["record_id"]), ("in_store", store.select("record_id").distinct(), ["record_id"])):
        out = out.join(table.withColumn(name, F.lit(True)).hint("merge"), keys, "left")  # ids shuffle to few bytes
    status = F.when(F.col("in_context"), "in_context").when(F.col("in_slice"), "out_of_context").when(F.col("in_store"), "post_cutoff").otherwise("fabricated")
    return out.withColumn("status", status).drop("in_context", "in_slice", "in_store")


def names_entity(kind: Column, own: Column, matched: Column, title: Column, entity: Column, symbol: Column) -> Column:
    """Whether a cited row names the entity: a measurement by its id, a publication by its matches or the symbol as a word."""
    word = F.coalesce(F.regexp_count(F.lower(title), F.concat(F.lit(r"(?<![0-9a-z])\Q"), F.lower(symbol), F.lit(r"\E(?![0-9a-z])"))) > 0, F.lit(False))
    return F.when(kind == "Measurement", F.coalesce(own == entity, F.lit(False))).when(kind == "Publication", F.coalesce(F.array_contains(matched, symbol), F.lit(False)) | word).otherwise(False)


def grounding(citations: DataFrame) -> DataFrame:
    """Per claim whether some citation is in context and names the entity; and the ids that it must not cite."""
    bad = lambda s: F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("record_id"))))
    return citations.groupBy("claim").agg(F.bool_or((F.col("status") == "in_context") & F.col("names")).alias("grounded"), F.count("*").alias("citations"), bad("post_cutoff").alias("post_cutoff"), bad("fabricated").alias("fabricated"))


def recalled(claims: DataFrame, truth: DataFrame, grounded: DataFrame) -> DataFrame:
    """Claims about later-established entities that no citation grounds."""
    return claims.join(truth.select("entity").distinct(), "entity", "left_semi").join(grounded.filter("grounded").select("claim"), "claim", "left_anti")


def eligible_holdouts(measurements: DataFrame, most: int = 12, least: int = 2) -> DataFrame:
    """The first ``most`` entities (by label, id) with at least ``least`` measurements; the number is the report's."""
    return measurements.groupBy("entity", "label").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy("label", "entity").limit(most)


def holdout_compare(with_data: DataFrame, without: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Claims with and without the hidden rows; an absent claim is (0.0, not reportable, 0)."""
    keys = [*(keys or []), "entity"]
    other = without.select(*keys, F.col("confidence").alias("confidence_without"), F.col("reportable").alias("reportable_without"), F.col("evidence").alias("evidence_without"))
    return with_data.join(other, keys, "left").fillna({"confidence_without": 0.0, "reportable_without": False, "evidence_without": 0})


def holdout_report(compared: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Over entities reportable with their data: how many still are, and the mean loss of confidence."""
    out = compared.filter("reportable").groupBy(*(keys or [])).agg(F.count("*").alias("tested"), F.count_if("reportable_without").alias("recovered"), F.round(F.avg(F.col("confidence") - F.col("confidence_without")), 6).alias("mean_drop"))
    return out.withColumn("rate", F.coalesce(F.col("recovered") / F.nullif(F.col("tested"), F.lit(0)), F.lit(0.0)))


#: Slots of a scorecard that one task draws for at once, and hits that a resample keeps of a part: five places are scored.
SLOTS, PLACES = 8192, 5


def bootstrap_intervals(units: DataFrame, keys: list[str], resamples: int = 2000, seed: int = 42) -> DataFrame:
    """95 % intervals of P@5, reciprocal rank and the rate of hits over resamples of the asked units, with replacement.

    ``units``: keys, unit, rank (null if not ranked), hit. Units are numbered in the order of rank and unit, over range parts,
    and dealt into chunks of ``SLOTS``. How many draws of a resample fall into a chunk is drawn by halving the scorecard again
    and again (a binomial for each half, seeded by resample and place), and inside a chunk every draw takes a unit at random: so
    any partitioning gives the same draws, and no draw of one resample is shared with another. A chunk turns them into a partial
    state per resample (drawn, hits, ranked draws, hits among the first five of these, the first hit's place), and states
    merge in the order of chunks: a chunk's places move back by the ranked draws before it. No task holds a scorecard.

    Nearest-rank percentiles of the sorted resamples. A scorecard without units has no row.
    """
    placed = ranked_by(units.select(*keys, "rank", "unit", F.coalesce("hit", F.lit(False)).alias("hit")), keys, [F.col("rank").asc_nulls_last(), F.col("unit")], "slot")
    sizes = units.groupBy(*keys).agg(F.count("*").alias("n"))
    rows = placed.join(sizes, keys).withColumn("slot", F.col("slot") - 1).withColumn("chunk", F.floor(F.col("slot") / SLOTS))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("slot")
        chunk, n = int(frame["chunk"].iloc[0]), int(frame["n"].iloc[0])
        hit, ranked = frame["hit"].to_numpy(bool), int(frame["rank"].notna().sum())
        states = [(chunk, r, *partial_state(drawn_of(seed, r, n, chunk), hit, ranked)) for r in range(resamples)]
        out = pd.DataFrame(states, columns=["chunk", "resample", "drawn", "hits", "places", "first5", "first"])
        for k in keys:
            out[k] = frame[k].iloc[0]
        return out

    kinds = ", ".join(f"`{k}` {units.schema[k].dataType.simpleString()}" for k in keys)
    states = rows.groupBy(*keys, "chunk").applyInPandas(run, f"chunk long, resample int, drawn long, hits long, places long, first5 array<boolean>, first long, {kinds}")
    return percentiles(merge_states(states, keys), keys, resamples)


def merge_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """Partial states (keys, chunk, resample, ...) to the three scores of every resample. Only the first five ranked draws
    count for P@5, so a chunk gives as many of its own as are still open after the chunks before it."""
    before = Window.partitionBy(*keys, "resample").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    moved = states.withColumn("ahead", F.coalesce(F.sum("places").over(before), F.lit(0)))
    own = F.slice("first5", 1, F.greatest(F.lit(0), PLACES - F.col("ahead")).cast("int"))
    of = F.size(F.filter(own, lambda x: x))
    return moved.groupBy(*keys, "resample").agg((F.sum(of) / PLACES).alias("p_at_5"), F.coalesce(1 / F.min(F.col("ahead") + F.col("first")), F.lit(0.0)).alias("reciprocal_rank"), (F.sum("hits") / F.sum("drawn")).alias("rate"))


def percentiles(scores: DataFrame, keys: list[str], resamples: int) -> DataFrame:
    low, high = int(resamples * 0.025), int(resamples * 0.975) - 1
    bounds = [F.round(F.get(F.array_sort(F.collect_list(m)), F.lit(i)), 6).alias(f"{m}_{side}") for m in ("p_at_5", "reciprocal_rank", "rate") for side, i in (("low", low), ("high", high))]
    return scores.groupBy(*keys).agg(*bounds)


def _stream(seed: int, resample: int, begin: int, end: int) -> np.random.Generator:
    """The random numbers of a resample for the slots from ``begin`` to ``end``: all four name the stream."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, resample, begin, end])))


def drawn_of(seed: int, resample: int, n: int, chunk: int) -> np.ndarray:
    """The places inside a chunk that a resample of ``n`` units draws there, sorted, each as often as it is drawn."""
    begin, end, draws = 0, -(-n // SLOTS), n
    while end - begin > 1:
        middle = (begin + end) // 2
        left, whole = (middle - begin) * SLOTS, min(n, end * SLOTS) - begin * SLOTS
        taken = int(_stream(seed, resample, begin, end).binomial(draws, left / whole))
        begin, end, draws = (begin, middle, taken) if chunk < middle else (middle, end, draws - taken)
    size = min(n, end * SLOTS) - begin * SLOTS
    return np.sort(_stream(seed, resample, begin, end).integers(0, size, size=draws))


def partial_state(drawn: np.ndarray, hit: np.ndarray, ranked: int) -> tuple[int, int, int, list[bool], int | None]:
    """drawn, hits, ranked draws, which of the first five of these hit, and the place of the first hit among them."""
    places = hit[drawn[: np.searchsorted(drawn, ranked)]]
    at = int(places.argmax()) + 1 if places.any() else None
    return len(drawn), int(hit[drawn].sum()), len(places), places[:PLACES].tolist(), at
