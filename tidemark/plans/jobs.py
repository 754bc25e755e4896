"""Whole jobs over dated tables: weighing and rules (C09), beliefs (C10), hold-outs (C19), grades (C14), per-gene tables (C22,
C23), and answers from outside (C18). ``keys`` (cutoff, ablation, ...) lead every grouping, so one job serves all slices.

Tables. measurements: keys, entity, record, pmid, p, assay, system, perturbation, phenotype, date, hit, author_reported.
phenotypes: phenotype, family, directness. publications: keys, entity, record, date, tier. edges: keys, src, dst, date, id.
genes: entity, family, locus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import policy
from tidemark.functions import rules as decisions
from tidemark.functions import scalars
from tidemark.operators import derive, forecast, grade, graph, ledger, merge, resolve, weigh

ASSOCIATION = "gwas_association"


@dataclass(frozen=True)
class Rules:
    """What C09 finds in a slice: the weighed rows, one table per rule kind, all rules in one form with the number of their
    records, and these records as rows (keys, entity, kind, record), so that no rule holds a list that grows with the data.
    Weighed rows and rule tables (without record_ids and systems) are stored, as much of what follows reads them."""

    weighed: DataFrame
    genetic: DataFrame
    essential: DataFrame
    functional: DataFrame
    literature: DataFrame
    composed: DataFrame
    routes: DataFrame
    all: DataFrame
    records: DataFrame


def weighed_rows(measurements: DataFrame, phenotypes: DataFrame, keys: list[str], p_most: float = policy.GENOME_WIDE, tables: dict[str, dict] | None = None, uniform: bool = False) -> DataFrame:
    """Measurements with trait_family and weight. ``phenotypes`` is a vocabulary and goes to every task: joined by
    shuffle, each of its few words would be one task's share of all measurements."""
    kinds = phenotypes.select("phenotype", F.col("family").alias("trait_family"))
    rows = weigh.directness_of(measurements, phenotypes).join(F.broadcast(kinds), "phenotype", "left")
    return weigh.weigh(rows, [*keys, "entity"], tables, uniform, p_most)


def weigh_and_extract(measurements: DataFrame, phenotypes: DataFrame, publications: DataFrame, edges: DataFrame, genes: DataFrame, keys: list[str], association: str = ASSOCIATION, p_most: float = policy.GENOME_WIDE, tables: dict[str, dict] | None = None, uniform: bool = False) -> Rules:
    """Weights (J11, J12), the five rule kinds with their records, and each rule's route; rules that the gate (P19) rejects
    are left out of ``all``."""
    by = [*keys, "entity"]
    weighed = forecast.stored(weighed_rows(measurements, phenotypes, keys, p_most, tables, uniform))  # five rule kinds and the evidence read it
    per_entity = lambda rules: forecast.stored(rules.drop("record_ids", "systems"))  # noqa: E731  the records are rows, see below
    own = F.col("trait_family") == "HBF"
    genetic = per_entity(derive.genetic_rules(weighed.filter(F.col("assay") == association), by, p_most))
    essential = per_entity(derive.essentiality_rules(weighed.filter("trait_family = 'FITNESS'"), by))
    functional = per_entity(derive.functional_rules(weighed.filter(own & (F.col("assay") != association)), by))
    literature = per_entity(derive.literature_rules(publications, by))
    best = derive.best_measurement(genetic, functional, by)
    composed = forecast.stored(derive.composition(edges, best, best, keys))
    count = F.col("records").cast("long")
    no_tier = F.lit(None).cast("long")

    def form(table: DataFrame, kind: str, direction, weight, records=count, tier=no_tier) -> DataFrame:
        rule_id = F.concat(F.lit(f"rule:{kind}:"), F.col("entity").cast("string")).alias("rule_id")
        return table.select(*by, rule_id, F.lit(kind).alias("kind"), direction.alias("direction"), weight.alias("weight"), records.alias("records"), tier.alias("tier_publications"))

    # of the tier's publications, or of all if there is none of the tier, as many as the cap lets count
    papers = F.least(F.lit(policy.LITERATURE_CAP), F.when(F.col("tier_publications") > 0, F.col("tier_publications")).otherwise(F.col("publications"))).cast("long")
    found = merge.union_all(
        form(genetic, "genetic", F.lit("none"), F.col("weight_total")),
        form(essential, "essentiality", F.when(F.col("pan_essential"), "decreases").otherwise("none"), F.col("weight_total"), F.col("n")),
        form(functional, "functional", F.lit("increases"), F.col("weight_total")),
        form(literature, "literature", F.lit("none"), F.col("weight"), papers, F.col("tier_publications")),
        form(composed, "composition", F.lit("increases"), F.col("transferred"), F.lit(1).cast("long")),
    )
    strong = weighed.filter((F.col("assay") == association) & scalars.significant(F.col("p"), p_most))
    fitness = weighed.filter("trait_family = 'FITNESS'").join(essential.select(*by), by, "left_semi")
    named = lambda rows, kind, record="record": rows.select(*by, F.lit(kind).alias("kind"), F.col(record).cast("string").alias("record"))
    records = merge.union_all(
        named(strong, "genetic"),
        named(fitness, "essentiality"),
        named(weighed.filter(own & (F.col("assay") != association)), "functional"),
        named(derive.literature_evidence(publications, by), "literature"),
        named(composed, "composition", "best_record"),
    )
    subjects = found.select(*by).distinct().join(genes, "entity")
    subjects = subjects.join(genetic.select(*by, F.lit(True).alias("cis_element")), by, "left").withColumn("raises", F.lit(True))
    routes = derive.modality_rules(subjects, essential, keys)
    checked = derive.gate(found.withColumns({"statement": F.col("rule_id"), "confidence": F.lit(0.0), "phenotype": F.lit("phenotype"), "subjects": F.array("entity")}), F.col("records"))
    kept = checked.filter("reject_reason IS NULL").select(*found.columns).join(routes.select(*by, "route"), by, "left")
    return Rules(weighed, genetic, essential, functional, literature, composed, routes, kept, records)


def gather_evidence(rules: Rules, publications: DataFrame, keys: list[str], association: str = ASSOCIATION, p_most: float = policy.GENOME_WIDE) -> DataFrame:
    """Four kinds of evidence as one table: keys, entity, date, record, direction, weight, kind, tier."""
    by = [*keys, "entity"]
    own = F.col("trait_family") == "HBF"
    strong = (F.col("assay") == association) & (F.coalesce(F.nullif("p", F.lit(0.0)), F.lit(1.0)) < p_most)
    columns = [*by, "date", F.col("record").cast("string").alias("record"), "direction", F.col("weight").cast("double").alias("weight"), "kind", "tier"]
    tag = lambda table, kind, tier=False: table.withColumns({"kind": F.lit(kind)} | ({} if tier else {"tier": F.lit(False)})).select(*columns)
    fitness = rules.weighed.filter("trait_family = 'FITNESS'").join(rules.essential.select(*by), by, "left_semi")
    measured = rules.weighed.filter((own & (F.col("assay") != association)) | strong).withColumn("direction", F.lit(1))
    papers = derive.literature_evidence(publications, by)  # at most LITERATURE_CAP of an entity, already numbered
    papers = papers.withColumns({"weight": ledger.literature_weight(F.col("k")), "direction": F.lit(1)})
    composed = rules.composed.select(*by, F.col("best_date").alias("date"), F.col("best_record").alias("record"), F.lit(1).alias("direction"), F.col("transferred").alias("weight"))
    return merge.union_all(tag(ledger.essentiality_increments(fitness.drop("weight"), by), "measurement"), tag(measured, "measurement"), tag(papers, "literature", True), tag(composed, "composition"))


def revise_beliefs(rules: Rules, publications: DataFrame, genes: DataFrame, keys: list[str], association: str = ASSOCIATION, p_most: float = policy.GENOME_WIDE, flat: bool = False) -> DataFrame:
    """A claim per entity that a rule is about, with the roll-up of its ledger; a claim without evidence stays at the prior.

    publications is the number of the tier's that name the entity, over all of them (not only those that count as evidence).
    """
    by = [*keys, "entity"]
    seeds = ledger.seed_claims(rules.all, genes, keys)
    rolled = ledger.roll_up(gather_evidence(rules, publications, keys, association, p_most), by, flat).drop("publications")
    out = seeds.join(rolled, by, "left")
    prior = {"log_odds": round(ledger.PRIOR, 6), "confidence": policy.PRIOR_CONFIDENCE, "evidence": 0}
    out = out.fillna(prior)
    return out.withColumn("reportable", decisions.reportable(F.col("confidence"), F.col("max_support"), F.col("publications"), F.col("max_composition")))


def hold_out(measurements: DataFrame, phenotypes: DataFrame, publications: DataFrame, edges: DataFrame, genes: DataFrame, keys: list[str], labels: DataFrame, most: int | None = 12, **options) -> DataFrame:
    """Each eligible entity's claim with and without its measurements, all in one job.

    Hiding an entity's measurements takes its own rules and their evidence away, and opens the route through its partners,
    whose measurements stay. Literature stays. Nothing else in the slice bears on its own claim: weights and replication
    counts are the entity's own. ``most``: how many entities a slice tests, by label (None: all).
    """
    by = [*keys, "entity"]
    full = weigh_and_extract(measurements, phenotypes, publications, edges, genes, keys, **options)
    plain = {k: v for k, v in options.items() if k in ("association", "p_most")}
    whole = revise_beliefs(full, publications, genes, keys, **plain)
    best = derive.best_measurement(full.genetic, full.functional, by)
    nothing = full.weighed.limit(0)
    # The entity hidden is the subject of its own composition; as a partner it would only bear on other claims.
    routed = derive.composition(edges.filter("src <> dst"), best, None, keys)
    left = Rules(nothing, full.genetic.limit(0), full.essential.limit(0), full.functional.limit(0), full.literature, routed, full.routes, merge.union_all(full.all.filter("kind = 'literature'"), routed.select(*by, F.concat(F.lit("rule:composition:"), F.col("entity").cast("string")).alias("rule_id"), F.lit("composition").alias("kind"))), full.records.limit(0))
    without = revise_beliefs(left, publications, genes, keys, **plain)
    counts = measurements.groupBy(*by).agg(F.count("*").alias("hidden")).filter("hidden >= 2").join(labels, "entity")
    eligible = counts if most is None else forecast.first_of(counts, keys, most, "label", "entity")
    return grade.holdout_compare(eligible.join(whole, by, "left").fillna({"confidence": 0.0, "reportable": False, "evidence": 0}), without, keys)


def scorecard(claims: DataFrame, ranked: DataFrame, truth: DataFrame, traps: DataFrame, keys: list[str]) -> DataFrame:
    """C14: (keys, metric, value) of a forecast: P@5, P@10 and reciprocal rank of both rankings, calibration error, traps,
    refusals, and how far cost moves the ranking. ``claims``: keys, entity, outcome, confidence; ``traps``: keys, entity, kind, answer."""
    other = ranked.withColumn("rank", F.col("cost_rank"))
    hits = truth.select(*keys, "entity", F.lit(True).alias("hit")).distinct()
    scored = claims.filter("outcome <> 'established'").join(hits, [*keys, "entity"], "left").fillna(False, ["hit"])
    outcomes = grade.trap_outcomes(traps, claims.join(ranked.select(*keys, "entity", "rank", "cost_rank"), [*keys, "entity"], "left"), keys)
    refuse = traps.filter("answer = 'refuse'").select(*keys, "entity").distinct()
    refused = refuse.join(claims.filter("outcome = 'refused'").select(*keys, "entity", F.lit(True).alias("said")), [*keys, "entity"], "left")
    tables = (
        (grade.ranking_metrics(ranked, truth, keys), "", ("p_at_5", "p_at_10", "reciprocal_rank", "hits", "ranked")),
        (grade.ranking_metrics(other, truth, keys), "cost_", ("p_at_5", "p_at_10", "reciprocal_rank")),
        (grade.calibration_error(grade.calibration_bins(scored, keys), keys), "", ("ece",)),
        (grade.trap_rollup(outcomes, keys), "traps_", ("passed", "vacuous", "meaningful", "judgement_total", "judgement", "contamination_total", "contamination")),
        (refused.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("said").alias("correct")), "refusals_", ("total", "correct")),
        (grade.cost_lens(ranked, keys), "cost_lens_", ("moved",)),
    )
    return merge.union_all(*[long_form(t, keys, prefix, names) for t, prefix, names in tables])


def long_form(table: DataFrame, keys: list[str], prefix: str, names: tuple[str, ...]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(prefix + n).alias("metric"), F.round(F.col(n).cast("double"), 6).alias("value")) for n in names]))
    return table.select(*keys, pairs.alias("m")).select(*keys, "m.metric", "m.value")


@dataclass(frozen=True)
class Library:
    """What citations are held against: ``context`` (keys, record_id: what a run was shown), ``nodes`` (record_id, kind, own,
    matched, title: the rows of the slice) and ``store`` (record_id: all rows, of any date)."""

    context: DataFrame
    nodes: DataFrame
    store: DataFrame


def answer_rows(answers: DataFrame, schema: str, entities: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Claims and refusals of answer JSON as one stream of rows, and each answer's status.

    Rows: keys, position, outcome (forecast or refused), entity (text), symbol, confidence (0 of a refusal), cited_ids. A name
    that no gene owns stays, as entity ``unresolved:NAME``. An answer that doesn't parse, has a confidence outside 0..1 or
    answers twice for a gene (also by two of its names, or by a claim and a refusal) fails whole.
    """
    checked = forecast.reliable(forecast.valid_answers(answers, schema, keys))
    part = lambda name, outcome, confidence, cited: F.transform(F.coalesce(name, F.array()), lambda c: F.struct(c["gene_symbol"].alias("name"), F.lit(outcome).alias("outcome"), confidence(c).alias("confidence"), cited(c).alias("cited_ids")))
    none = F.array().cast("array<string>")
    claims = part(F.col("parsed.claims"), "forecast", lambda c: c["confidence"], lambda c: F.coalesce(c["cited_ids"], none))
    refusals = part(F.col("parsed.refusals"), "refused", lambda c: F.lit(0.0), lambda c: none)
    rows = checked.filter("status = 'ok'").select(*keys, F.posexplode(F.concat(claims, refusals)).alias("position", "row")).select(*keys, "position", "row.*")
    names = entities.select(F.col("id").cast("string").alias("entity"), F.upper("symbol").alias("own_symbol"))
    found = resolve.resolve_in_graph(rows, entities).withColumn("entity", F.col("id").cast("string")).join(names.hint("merge"), "entity", "left")
    written = F.upper(F.trim("name"))
    found = found.select(*keys, "position", "outcome", F.coalesce("entity", F.concat(F.lit("unresolved:"), written)).alias("entity"), F.coalesce("own_symbol", written).alias("symbol"), "confidence", "cited_ids")
    twice = found.groupBy(*keys).agg((F.count("*") > F.count_distinct("entity")).alias("twice"))
    status = checked.join(twice.hint("merge"), keys, "left").select(*keys, F.when(F.coalesce("twice", F.lit(False)), "two answers for a gene").otherwise(F.col("status")).alias("status"))
    return found.join(status.filter("status = 'ok'").select(*keys).hint("merge"), keys, "left_semi"), status


def check_citations(claims: DataFrame, library: Library, keys: list[str]) -> DataFrame:
    """Keys, entity, record_id, status and whether the cited row of the slice names the claim's gene."""
    cited = claims.select(*keys, "entity", "symbol", F.explode("cited_ids").alias("record_id"))
    shown = library.context.join(library.nodes.select("record_id").hint("merge"), "record_id", "left_semi")  # only rows of the slice can be shown
    found = grade.classify_citations(cited, shown, library.nodes, library.store, keys)
    named = found.join(library.nodes.hint("merge"), "record_id", "left")
    names = grade.names_entity(F.col("kind"), F.col("own").cast("string"), F.col("matched"), F.col("title"), F.col("entity"), F.col("symbol"))
    return named.select(*keys, "entity", "record_id", "status", F.coalesce(names, F.lit(False)).alias("names"))


def score_answers(answers: DataFrame, schema: str, entities: DataFrame, truth: DataFrame, keys: list[str], library: Library, traps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers from outside to ranked claims (keys, entity, symbol, confidence, rank, grounded) and a report per answer:
    ranking metrics, citations by status, grounded claims (A23), recalled claims (J22: about later-established genes, without
    a grounding citation) and trap outcomes (A20). ``traps``: keys, entity, kind, answer. Entities of ``truth`` and ``traps``
    are compared as text. An answer that fails gets zeros."""
    said, status = answer_rows(answers, schema, entities, keys)
    said = forecast.reliable(said)
    text = lambda t: t.withColumn("entity", F.col("entity").cast("string"))
    apart = lambda t: t.hint("merge")  # noqa: E731  a row per answer or more: its shuffled bytes are few, its rows too many to broadcast
    truth, traps = apart(text(truth).select(*keys, "entity").distinct()), text(traps)
    claims = said.filter("outcome = 'forecast'")
    citations = forecast.reliable(check_citations(claims, library, keys))
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    cited = citations.groupBy(*keys).agg(F.count("*").alias("citations"), *map(count, ("in_context", "out_of_context", "post_cutoff", "fabricated")))
    grounded = citations.filter("status = 'in_context' AND names").select(*keys, "entity").distinct().withColumn("grounded", F.lit(True))
    ranked = forecast.rank_answers(claims.drop("outcome", "cited_ids"), keys).join(apart(grounded), [*keys, "entity"], "left").fillna(False, ["grounded"])
    later = ranked.join(truth, [*keys, "entity"], "left_semi").groupBy(*keys).agg(F.count("*").alias("post_cutoff_claims"), F.count_if(~F.col("grounded")).alias("recalled"))
    of_claims = ranked.groupBy(*keys).agg(F.count_if("grounded").alias("grounded_claims"))
    ranks = ranked.select(*keys, "entity", "rank", F.col("rank").alias("cost_rank"))
    answered = traps.join(apart(status.filter("status = 'ok'").select(*keys)), keys, "left_semi")
    outcomes = grade.trap_rollup(grade.trap_outcomes(apart(answered), said.join(apart(ranks), [*keys, "entity"], "left"), keys), keys).select(*keys, "traps", F.col("passed").alias("traps_passed"))
    refused = said.groupBy(*keys).agg(F.count_if(F.col("outcome") == "refused").alias("refusals"))
    report = status
    for table in (grade.ranking_metrics(ranked, truth, keys), refused, cited, of_claims, later, outcomes):
        report = report.join(apart(table), keys, "left")
    return ranked, report.fillna(0)


def gene_tables(verdicts: DataFrame) -> DataFrame:
    """A row per entity: its verdicts and confidences by cutoff, how often the verdict changed, and its best one."""
    order = ("hit", "forecast", "missed", "known", "refused", "none")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("verdict"))
    past = forecast.history(verdicts)
    steps = F.array_sort(F.collect_list(F.struct("cutoff", "verdict", "confidence")))
    return past.groupBy("entity").agg(steps.alias("steps"), F.count_if("changed").alias("changes"), F.min_by("verdict", place).alias("best"), F.max("confidence").alias("top_confidence"))


def gene_index(said: DataFrame, traps: DataFrame, established: DataFrame, cutoffs: list[str]) -> DataFrame:
    """A row per entity that anything is said about: when it became established, the cutoffs at which it was forecast and at
    which it was ground truth, whether it served as a trap, and its verdict at every cutoff, 'none' where a slice is silent.

    ``said``: cutoff, entity, outcome (null: none), true; ``traps``: entity; ``established``: entity, established. What the
    tables say is folded in one grouping, with a column per cutoff; nothing is collected per entity but ``cutoffs`` itself.
    """
    none = lambda kind: F.lit(None).cast(kind)
    rows = merge.union_all(
        said.select("entity", F.col("cutoff").cast("string").alias("cutoff"), "outcome", "true", F.lit(False).alias("trap"), none("date").alias("established")),
        traps.select("entity", none("string").alias("cutoff"), none("string").alias("outcome"), F.lit(False).alias("true"), F.lit(True).alias("trap"), none("date").alias("established")),
        established.select("entity", none("string").alias("cutoff"), none("string").alias("outcome"), F.lit(False).alias("true"), F.lit(False).alias("trap"), "established"),
    )
    tests = {o: F.col("outcome") == o for o in ("established", "forecast", "refused")} | {"true": F.col("true")}
    at = {f"{name}_{i}": F.coalesce(F.bool_or((F.col("cutoff") == c) & test), F.lit(False)) for i, c in enumerate(cutoffs) for name, test in tests.items()}
    out = rows.groupBy("entity").agg(F.min("established").alias("established"), F.bool_or("trap").alias("trapped"), *[c.alias(n) for n, c in at.items()])
    when = lambda name: F.filter(F.array(*[F.when(F.col(f"{name}_{i}"), F.lit(c)) for i, c in enumerate(cutoffs)]), lambda x: x.isNotNull())
    verdicts = F.array(*[decisions.verdict(*[F.col(f"{name}_{i}") for name in tests]) for i in range(len(cutoffs))])
    return out.select("entity", "established", "trapped", when("forecast").alias("forecast_at"), when("true").alias("truth_at"), verdicts.alias("verdicts"))


def evidence_points(said: DataFrame) -> DataFrame:
    """How much evidence each claim that a slice weighed has, and how confident that made it: cutoff, entity, evidence,
    confidence, verdict. What was established before the cutoff isn't weighed. ``said``: those and outcome, true."""
    is_ = lambda o: F.col("outcome") == o
    verdict = decisions.verdict(is_("established"), is_("forecast"), is_("refused"), F.col("true"))
    return said.filter(F.col("outcome").isin("forecast", "refused")).select("cutoff", "entity", "evidence", "confidence", verdict.alias("verdict"))


def profile(measurements: DataFrame, publications: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Per entity, in one pass each: measurements by assay, publications, partners, the newest measurement and publication."""
    assays = graph.measurements_by_assay(measurements)
    by_assay = assays.groupBy("entity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("assay", "n")))).alias("by_assay"), F.sum("n").alias("measurements"))
    newest = lambda t, name: t.groupBy("entity").agg(F.min_by("record", F.struct(-F.unix_date("date"), "record")).alias(name))
    papers = publications.groupBy("entity").agg(F.count("*").alias("publications"))
    links = edges.select(F.col("src").alias("entity"), F.col("dst").alias("partner")).union(edges.select("dst", "src")).distinct().groupBy("entity").agg(F.count("*").alias("partners"))
    out = entities.select("entity")
    for table in (by_assay, papers, links, newest(measurements, "latest_measurement"), newest(publications, "latest_publication")):
        out = out.join(table, "entity", "left")
    return out.fillna(0, ["measurements", "publications", "partners"])
