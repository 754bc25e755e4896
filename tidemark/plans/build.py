"""The dated graph from its accepted rows, with exclusions and a report; C21: tables of a scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.operators import forecast, ingest, ledger, merge, slices
from tidemark.plans import jobs


def build_graph(tagged: list[DataFrame], nodes: list[DataFrame], edges: list[DataFrame]) -> dict[str, DataFrame]:
    """Nodes and edges last-written by id, edges without an end among the exclusions, and counts by reason and source.

    ``tagged``: tables with source, source_id and reject_reason; ``nodes`` and ``edges`` have load_order.
    """
    node = forecast.stored(merge.last_write(merge.union_all(*nodes), ["id"], "load_order").drop("load_order"))
    edge = forecast.stored(merge.last_write(merge.union_all(*edges), ["id"], "load_order").drop("load_order"))
    lost = forecast.stored(slices.dangling(node.hint("merge"), edge))  # ids shuffle to few bytes, too many to broadcast
    kept = edge.join(lost.select("id").hint("merge"), "id", "left_anti")
    excluded = merge.union_all(*[ingest.split(t)[1] for t in tagged], lost.select(F.lit("graph").alias("source"), F.col("id").alias("source_id"), F.concat(F.lit("missing "), "missing").alias("reason")))
    return {"nodes": node, "edges": kept, "exclusions": excluded, "report": merge.report(excluded, "source", "reason")}


def reconcile(tagged: list[DataFrame]) -> DataFrame:
    """Source, and how many of its rows were read, kept and excluded; what was read is what was kept and what was excluded."""
    rows = merge.union_all(*[t.select("source", "reject_reason") for t in tagged])
    return rows.groupBy("source").agg(F.count("*").alias("read"), F.count_if(F.col("reject_reason").isNull()).alias("kept"), F.count_if(F.col("reject_reason").isNotNull()).alias("excluded"))


def from_sources(genes: DataFrame, literature: DataFrame, screens: DataFrame, tested: DataFrame, associations: DataFrame, essentiality: DataFrame, evidence: DataFrame, trials: DataFrame) -> dict[str, DataFrame]:
    """The graph of all sources, from the tagged rows that C02 to C07 and P16 make of them: what ``build_graph`` gives, and
    sources, the rows read, kept and excluded of each (``reconcile``). ``screens`` and ``tested``: both results of C02, whose
    genes are ids as in ``genes`` without their prefix.

    Vocabularies come first, so that a source's row of the same id replaces theirs. Each source is read once and stored.
    """
    columns = {"genes": ["id", "symbol", "effective_date"], "literature": ["pmid", "title", "date"], "screens": ["date"], "tested": ["id", "screen_id", "gene", "pmid", "date", "system", "perturbation"], "associations": ["id", "date"], "essentiality": ["date"], "evidence": ["date"], "trials": ["title", "date"]}
    given = dict(genes=genes, literature=literature, screens=screens, tested=tested, associations=associations, essentiality=essentiality, evidence=evidence, trials=trials)
    tagged = {name: forecast.stored(given[name].select("source", "source_id", "reject_reason", *columns[name])) for name in given}
    good = {name: ingest.split(table)[0] for name, table in tagged.items()}

    def node(name: str, kind: str, key: Column, label: Column, date: str = "date") -> DataFrame:
        return good[name].select(key.alias("id"), F.lit(kind).alias("type"), label.alias("label"), F.col(date).alias("effective_date"), F.lit(1).alias("load_order"))

    source_id = F.col("source_id")
    prefixed = lambda prefix, key=source_id: F.concat(F.lit(prefix), key)
    nodes = [
        ingest.vocabulary(genes.sparkSession).select("id", "type", "label", "effective_date", F.lit(0).alias("load_order")),
        node("genes", "Gene", F.col("id"), F.col("symbol"), "effective_date"),
        node("literature", "Publication", prefixed("pub:", F.col("pmid")), F.col("title")),
        node("screens", "Screen", source_id, source_id),
        node("tested", "Measurement", F.col("id"), F.col("id")).filter("id IS NOT NULL"),
        node("associations", "Measurement", F.col("id"), F.col("id")),
        node("essentiality", "Measurement", prefixed("meas:depmap:"), source_id),
        node("evidence", "Measurement", prefixed("meas:ot:"), source_id),
        node("trials", "Trial", prefixed("trial:"), F.col("title")),
        good["tested"].filter("system IS NOT NULL").groupBy("system").agg(F.min("date").alias("effective_date")).select(prefixed("cell:", F.col("system")).alias("id"), F.lit("CellContext").alias("type"), F.col("system").alias("label"), "effective_date", F.lit(1).alias("load_order")),
    ]
    edges = ingest.screen_edges(tagged["tested"]).withColumns({"id": F.concat_ws("|", "type", "src", "dst"), "load_order": F.lit(0)})
    return build_graph(list(tagged.values()), nodes, [edges]) | {"sources": reconcile(list(tagged.values()))}


def scorecard(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(cutoff, run, metric, value, lower, upper) as a row per cutoff and run, a missing metric shown as not run."""
    shown = F.when(F.col("lower").isNull(), rules.places(F.col("value"), 3)).otherwise(F.concat(rules.places(F.col("value"), 2), F.lit(" ["), rules.places(F.col("lower"), 2), F.lit(", "), rules.places(F.col("upper"), 2), F.lit("]")))
    return metrics.withColumn("shown", shown).groupBy("cutoff", "run").pivot("metric", names).agg(F.first("shown")).fillna("not run", names)


def ablation_table(results: DataFrame, cutoff: str, names: list[str]) -> DataFrame:
    """A row per ablation of one slice, its metrics to three places; a metric that a run lacks is shown as not run.
    ``results``: cutoff, ablation, metric, value."""
    rows = results.filter(F.col("cutoff") == F.lit(cutoff)).withColumn("shown", F.format_string("%.3f", F.round("value", 3)))
    return rows.groupBy("ablation").pivot("metric", names).agg(F.first("shown")).fillna("not run", names)


def trap_table(outcomes: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    """Every trap with what was asked, what the slice answered, and how that counts. A trap that postdates the cutoff tests for
    contamination, and one that no forecast could fail is passed in name only. ``outcomes``: keys, entity, kind, answer, passed,
    vacuous; ``claims``: keys, entity, outcome. A claim that isn't there, or was established already, is no answer: absent."""
    said = claims.select(*keys, "entity", F.when(F.col("outcome") == "forecast", "accept").when(F.col("outcome") == "refused", "refuse").alias("system_answer"))
    how = F.when(F.col("kind") == "postdates_cutoff", "pass (contamination check)").when(F.col("vacuous"), "pass (vacuous)").otherwise("pass")
    rows = outcomes.join(said, [*keys, "entity"], "left").fillna("absent", ["system_answer"])
    return rows.select(*keys, "entity", "kind", F.col("answer").alias("correct_answer"), "system_answer", F.when(F.col("passed"), how).otherwise("FAIL").alias("result"))


def reliability_table(bins: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Calibration bins as their bounds, the number of claims, and both rates to three places."""
    place = lambda c: F.format_string("%.3f", F.round(c, 3)).alias(c)
    bounds = F.format_string("%.1f to %.1f", F.col("bin") * F.lit(width), (F.col("bin") + 1) * F.lit(width)).alias("confidence_bin")
    return bins.select(*keys, bounds, F.col("n").alias("claims"), place("mean_confidence"), place("observed"))


METRICS = ("p_at_5", "p_at_10", "reciprocal_rank", "hits", "ranked", "cost_p_at_5", "cost_p_at_10", "cost_reciprocal_rank", "ece", "traps_passed", "traps_vacuous", "traps_meaningful", "traps_judgement", "traps_contamination", "refusals_total", "refusals_correct", "cost_lens_moved")


def run_matrix(evidence: DataFrame, established: DataFrame, traps: DataFrame, truth: DataFrame, slots: dict, keys: list[str], route: Column, route_weight: Column) -> DataFrame:
    """Every slice under every ablation, from one fold of the evidence: keys, ablation, metric, value (C14 for each). A metric
    that a run has no rows for is 0. ``traps``: keys, entity, kind, answer; ``truth``: keys, entity; ``slots`` as in ``roll_up_slots``."""
    by, names = [*keys, "ablation"], F.explode(F.array(*map(F.lit, slots))).alias("ablation")
    claims = forecast.reliable(forecast.decide(ledger.roll_up_slots(evidence, [*keys, "entity"], slots), established, [*by, "entity"]))
    items = claims.filter("outcome = 'forecast'").withColumns({"symbol": F.col("entity").cast("string"), "route": route})
    ranked = forecast.reliable(forecast.rank_two_ways(items, by, route_weight))
    card = jobs.scorecard(claims, ranked, truth.select("*", names), traps.select("*", names), by)
    frame = claims.select(*by).distinct().select("*", F.explode(F.array(*map(F.lit, METRICS))).alias("metric"))
    return frame.join(card, [*by, "metric"], "left").fillna(0.0, ["value"])


def effects(results: DataFrame, same: float = 0.002, whole: str = "full") -> DataFrame:
    """Each ablation's metric against the full run of its cutoff: same, better or worse."""
    full = results.filter(F.col("ablation") == whole).select("cutoff", "metric", F.col("value").alias("full_value"))
    change = F.col("value") - F.col("full_value")
    return results.join(full, ["cutoff", "metric"]).withColumn("effect", F.when(F.abs(change) <= same, "same").when(change > 0, "better").otherwise("worse"))
