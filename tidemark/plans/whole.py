"""The composite jobs over the driver's tables, with their SQL: lineitem rows are measurements and publications of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.operators import derive, forecast, grade, graph, merge, resolve, slices, traps, weigh
from tidemark.plans import build, jobs
from tidemark.plans.driver import _BASE, _BINS, _CUTS, _EV, _HITS, _PRIOR, _TRAPS, _TRUTH, ASSAYS, CUTS, FAMILIES, GRAPH_CUTS, P_MOST, PERTURBATIONS, ROUTES, SYSTEMS, decided, established, evidence, longs, part_entities, part_pairs, query, ranked, read, scored, trap_rows, truth_by_cutoff

OPTIONS = {"association": "A", "p_most": P_MOST, "tables": {"system": SYSTEMS, "assay": ASSAYS, "perturbation": PERTURBATIONS}}


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """measurements, phenotypes, publications, edges and genes at every cutoff of the graph."""
    c = F.col
    lines = read(spark, d, "lineitem").select(c("l_partkey").alias("entity"), c("l_orderkey").alias("pmid"), ((c("l_orderkey") * 10 + c("l_linenumber")) * 100_000 + c("l_suppkey")).alias("record"), c("l_shipdate").cast("date").alias("date"), c("l_shipdate").cast("date").alias("effective_date"), (c("l_discount") + 0.001).alias("p"), c("l_returnflag").alias("assay"), c("l_linestatus").alias("system"), F.least(c("l_linenumber"), F.lit(2)).alias("perturbation"), c("l_tax"), c("l_quantity"), c("l_linenumber"), c("l_discount"))
    lines = slices.asof(lines, GRAPH_CUTS).withColumn("cutoff", c("cutoff").cast("string"))
    kinds = F.element_at(F.array(F.lit("cell_fitness"), F.lit("hbf_protein"), F.lit("hbg_mrna")), c("l_linenumber") % 3 + 1)
    m = lines.filter("l_tax < 0.055").select("cutoff", "entity", "pmid", "record", "date", "p", "assay", "system", "perturbation", kinds.alias("phenotype"), (c("l_quantity") > 10).alias("hit"), (c("l_tax") > 0.035).alias("author_reported"))
    p = lines.filter("l_tax > 0.055").select("cutoff", "entity", "record", "date", (c("l_discount") > 0.045).alias("tier"))
    phenotypes = spark.createDataFrame([("cell_fitness", "FITNESS", "proxy"), ("hbf_protein", "HBF", "direct_protein"), ("hbg_mrna", "HBF", "transcript")], "phenotype string, family string, directness string")
    cuts = F.explode(F.array(*[F.lit(x) for x in GRAPH_CUTS])).alias("cutoff")
    genes = read(spark, d, "part").select(c("p_partkey").alias("entity"), rules.lookup(FAMILIES, c("p_type")).alias("family"), F.when(c("p_size") < 3, "RNA, long non-coding").otherwise("gene with protein product").alias("locus"))
    return {"measurements": m, "phenotypes": phenotypes, "publications": p, "edges": part_pairs(spark, d).select("*", cuts), "genes": genes}


_JOB = """c(cutoff) AS (VALUES ('1996-01-01'), ('1998-01-01'), ('2000-01-01')),
  l AS (SELECT cutoff, l_partkey AS entity, l_orderkey AS pmid, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS record, CAST(l_shipdate AS DATE) AS date, l_discount, l_returnflag AS assay, l_linestatus AS system, least(l_linenumber, 2) AS perturbation, l_tax, l_quantity, l_linenumber
    FROM lineitem JOIN c ON CAST(l_shipdate AS DATE) < CAST(cutoff AS DATE)),
  m AS (SELECT *, l_discount + 0.001 AS p, CASE l_linenumber % 3 WHEN 0 THEN 'cell_fitness' WHEN 1 THEN 'hbf_protein' ELSE 'hbg_mrna' END AS phenotype, CASE l_linenumber % 3 WHEN 0 THEN 0.35 WHEN 1 THEN 1.0 ELSE 0.65 END AS direct, l_quantity > 10 AS hit, l_tax > 0.035 AS author_reported FROM l WHERE l_tax < 0.055),
  pub AS (SELECT cutoff, entity, record, date, l_discount > 0.045 AS tier FROM l WHERE l_tax > 0.055),
  st AS (SELECT cutoff, entity, count(DISTINCT pmid) AS replicates, bool_or(p < 0.005) AS supported FROM m GROUP BY ALL),
  w AS (SELECT m.*, round(least(greatest(CASE system WHEN 'O' THEN 1.0 WHEN 'F' THEN 0.3471313 ELSE 0.1 END * CASE perturbation WHEN 1 THEN 1.0 WHEN 2 THEN 0.7091717 ELSE 0.35 END * direct
    * CASE WHEN replicates <= 1 THEN 1.0 WHEN replicates = 2 THEN 1.35 WHEN replicates = 3 THEN 1.55 ELSE 1.7 END * CASE WHEN supported THEN 1.3 ELSE 1.0 END
    * CASE assay WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.6131313 WHEN 'R' THEN 0.2573373 ELSE 0.5 END * CASE WHEN author_reported THEN 0.55 ELSE 1.0 END, 0.01), 2.0), 6) AS weight FROM m JOIN st USING (cutoff, entity)),
  gen AS (SELECT cutoff, entity, round(sum(weight), 6) AS weight, max(weight) AS best_weight, arg_max(record, (weight, record)) AS best_record, arg_max(date, (weight, record)) AS best_date, count(*) AS n FROM w WHERE assay = 'A' AND p < 0.005 GROUP BY ALL),
  ess AS (SELECT cutoff, entity, round(sum(weight), 6) AS weight, count(*) AS n, count(*) FILTER (WHERE hit) / count(*) AS fraction FROM w WHERE phenotype = 'cell_fitness' GROUP BY ALL HAVING count(*) >= 3),
  fun AS (SELECT cutoff, entity, round(sum(weight), 6) AS weight, max(weight) AS best_weight, (list(record ORDER BY weight DESC, date, record))[1] AS best_record, (list(date ORDER BY weight DESC, date, record))[1] AS best_date, count(*) AS n FROM w WHERE phenotype <> 'cell_fitness' AND assay <> 'A' GROUP BY ALL),
  best AS (SELECT cutoff, entity, best_weight, best_record, best_date FROM (SELECT *, row_number() OVER (PARTITION BY cutoff, entity ORDER BY best_weight DESC, k) AS r FROM (SELECT *, 0 AS k FROM gen UNION ALL SELECT *, 1 FROM fun)) WHERE r = 1),
  pairs AS (SELECT a.p_partkey AS src, b.p_partkey AS dst FROM part a JOIN part b ON a.p_partkey // 4 = b.p_partkey // 4 AND a.p_partkey <> b.p_partkey),
  routed AS (SELECT cutoff, entity, partner, best_record, best_date, transferred FROM (SELECT *, row_number() OVER (PARTITION BY cutoff, entity ORDER BY transferred DESC, partner) AS r FROM
    (SELECT cutoff, src AS entity, dst AS partner, best_record, best_date, (35 * CAST(round(best_weight * 1000000) AS BIGINT) + 50) // 100 / 1000000.0 AS transferred FROM pairs JOIN best ON best.entity = dst)) WHERE r = 1),
  com AS (SELECT routed.* FROM routed ANTI JOIN best USING (cutoff, entity)),
  lit AS (SELECT cutoff, entity, count(*) AS n, count(*) FILTER (WHERE tier) AS tiers, round(0.20 * count(*) FILTER (WHERE tier) + 0.05 * count(*) FILTER (WHERE NOT tier), 6) AS weight FROM pub GROUP BY ALL),
  used AS (SELECT *, row_number() OVER (PARTITION BY cutoff, entity ORDER BY date, record) AS k FROM (SELECT *, bool_or(tier) OVER (PARTITION BY cutoff, entity) AS has FROM pub) WHERE tier OR NOT has),
  papers AS (SELECT cutoff, entity, (ln(1 + k) - ln(k)) * CASE WHEN tier THEN 1.0 ELSE 0.25 END AS delta, date, record FROM used WHERE k <= 400),
  fit AS (SELECT w.cutoff, w.entity, w.date, w.record, fraction, row_number() OVER (PARTITION BY w.cutoff, w.entity ORDER BY w.date, w.record) AS k, count(*) OVER (PARTITION BY w.cutoff, w.entity) AS n FROM w JOIN ess ON ess.cutoff = w.cutoff AND ess.entity = w.entity WHERE phenotype = 'cell_fitness' AND hit AND fraction >= 0.70),
  own AS (SELECT cutoff, entity, date, record, weight * 0.85 AS delta, weight AS support FROM w WHERE (phenotype <> 'cell_fitness' AND assay <> 'A') OR (assay = 'A' AND p < 0.005)),
  ev AS (SELECT cutoff, entity, date, record, delta, support, NULL AS transferred, 'measurement' AS kind FROM own UNION ALL SELECT cutoff, entity, date, record, -1.2 * fraction * (ln(1 + k) - ln(k)) / ln(1 + n), NULL, NULL, 'measurement' FROM fit
    UNION ALL SELECT cutoff, entity, date, record, delta, NULL, NULL, 'literature' FROM papers UNION ALL SELECT cutoff, entity, best_date, best_record, transferred * 0.85, NULL, transferred, 'composition' FROM com)"""
_PROPER = "part p JOIN (SELECT DISTINCT cutoff, entity FROM (SELECT cutoff, entity FROM gen UNION ALL SELECT cutoff, entity FROM ess UNION ALL SELECT cutoff, entity FROM fun UNION ALL SELECT cutoff, entity FROM lit UNION ALL SELECT cutoff, entity FROM com)) s ON s.entity = p_partkey"
_ROUTE = """CASE WHEN coalesce(fraction >= 0.7, false) THEN 'NOT_THERAPEUTIC' WHEN p_size < 3 THEN 'EX_VIVO_SINGLE_EDIT' WHEN p_type IN ('ECONOMY', 'MEDIUM') THEN 'SMALL_MOLECULE'
  WHEN gen.entity IS NOT NULL THEN 'EX_VIVO_SINGLE_EDIT' WHEN p_type = 'STANDARD' THEN 'EX_VIVO_MULTI_EDIT' ELSE 'EX_VIVO_SINGLE_EDIT' END"""
_CLAIMS = f"""claims AS (SELECT s.cutoff, s.entity, {_ROUTE} AS route, coalesce(tiers, 0) AS publications FROM {_PROPER} LEFT JOIN ess ON ess.cutoff = s.cutoff AND ess.entity = s.entity LEFT JOIN gen ON gen.cutoff = s.cutoff AND gen.entity = s.entity LEFT JOIN lit ON lit.cutoff = s.cutoff AND lit.entity = s.entity),
  roll AS (SELECT cutoff, entity, {_PRIOR} + sum(delta) AS z, count(*) AS evidence, max(support) AS max_support, max(transferred) AS max_composition FROM ev GROUP BY ALL),
  done AS (SELECT cutoff, entity, route, publications, coalesce(z, {_PRIOR}) AS z, coalesce(evidence, 0) AS evidence, max_support, max_composition, 1 / (1 + exp(-coalesce(z, {_PRIOR}))) AS confidence FROM claims LEFT JOIN roll USING (cutoff, entity)),
  said AS (SELECT *, round(confidence, 6) >= 0.25 AND (coalesce(max_support, 0) >= 0.30 OR publications >= 5 OR coalesce(max_composition, 0) >= 0.25) AS reportable FROM done)"""


def rule_set(spark: SparkSession, d: str, **more) -> tuple[jobs.Rules, dict[str, DataFrame]]:
    t = tables(spark, d)
    return jobs.weigh_and_extract(t["measurements"], t["phenotypes"], t["publications"], t["edges"], t["genes"], ["cutoff"], **(OPTIONS | more)), t


def beliefs(spark: SparkSession, d: str, **more) -> DataFrame:
    found, t = rule_set(spark, d, **more)
    return jobs.revise_beliefs(found, t["publications"], t["genes"], ["cutoff"], "A", P_MOST)


@query("c09_weigh_and_extract", f"""WITH {_JOB}, {_CLAIMS}, ids AS (SELECT cutoff, entity, 'genetic' AS kind, 'none' AS direction, weight, n FROM gen UNION ALL SELECT cutoff, entity, 'essentiality', CASE WHEN fraction >= 0.7 THEN 'decreases' ELSE 'none' END, weight, n FROM ess
  UNION ALL SELECT cutoff, entity, 'functional', 'increases', weight, n FROM fun UNION ALL SELECT lit.cutoff, lit.entity, 'literature', 'none', weight, (SELECT count(*) FROM used WHERE k <= 400 AND used.cutoff = lit.cutoff AND used.entity = lit.entity) FROM lit UNION ALL SELECT cutoff, entity, 'composition', 'increases', transferred, 1 FROM com)
SELECT cutoff, entity, kind, direction, weight, n AS records, route FROM ids JOIN claims USING (cutoff, entity)""")
def c09(spark: SparkSession, d: str) -> DataFrame:
    found, _ = rule_set(spark, d)
    return found.all.select("cutoff", "entity", "kind", "direction", "weight", "records", "route")


_MATRIX = f"""WITH {_EV}, {_CUTS}, {_TRUTH}, {_HITS}, x AS (SELECT cutoff, entity, ab, direction, kind, tier, CASE ab WHEN 'no method signature' THEN 1.0 ELSE weight END AS weight, ab <> 'no belief revision' AS moves, ab <> 'no literature' OR kind <> 'literature' AS keep
    FROM ev JOIN cuts ON date < cutoff CROSS JOIN (VALUES ('full system'), ('no method signature'), ('no belief revision'), ('no literature')) t(ab)),
  rl AS (SELECT cutoff, ab, entity, round(1 / (1 + exp(-({_PRIOR} + coalesce(sum(direction * weight * 0.85) FILTER (WHERE keep AND moves), 0)))), 6) AS confidence, max(CASE WHEN keep AND direction > 0 AND kind IN ('measurement', 'genetic') THEN weight END) AS s, max(CASE WHEN keep AND direction > 0 AND kind = 'composition' THEN weight END) AS m,
    count(*) FILTER (WHERE keep AND kind = 'literature' AND tier) AS n FROM x GROUP BY ALL),
  dc AS (SELECT rl.*, CASE WHEN established < rl.cutoff THEN 'established' WHEN confidence >= 0.25 AND (coalesce(s, 0) >= 0.30 OR n >= 5 OR coalesce(m, 0) >= 0.25) THEN 'forecast' ELSE 'refused' END AS outcome, h.entity IS NOT NULL AS hit FROM rl LEFT JOIN truth USING (entity) LEFT JOIN hits h ON h.cutoff = rl.cutoff AND h.entity = rl.entity),
  rk AS (SELECT *, row_number() OVER (PARTITION BY cutoff, ab ORDER BY confidence DESC, CAST(entity AS VARCHAR)) AS rank FROM dc WHERE outcome = 'forecast'),
  tp AS (SELECT cutoff, ab, entity, entity % 3 AS answer, outcome, rank FROM (SELECT DISTINCT entity FROM ev) CROSS JOIN cuts CROSS JOIN (SELECT DISTINCT ab FROM x) LEFT JOIN (SELECT dc.cutoff, dc.ab, dc.entity, dc.outcome, rk.rank FROM dc LEFT JOIN rk USING (cutoff, ab, entity)) USING (cutoff, ab, entity)),
  bn AS (SELECT cutoff, ab, least(CAST(floor(confidence * 5) AS INT), 4) AS bin, count(*) AS n, avg(confidence) AS mc, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS ob FROM dc WHERE outcome <> 'established' GROUP BY ALL),
  runs AS (SELECT DISTINCT cutoff, ab FROM dc),
  v AS (SELECT cutoff, ab, 'p_at_5' AS metric, count(*) FILTER (WHERE hit AND rank <= 5) / 5 AS value FROM rk GROUP BY ALL UNION ALL SELECT cutoff, ab, 'p_at_10', count(*) FILTER (WHERE hit AND rank <= 10) / 10 FROM rk GROUP BY ALL UNION ALL SELECT cutoff, ab, 'reciprocal_rank', coalesce(1 / min(CASE WHEN hit THEN rank END), 0) FROM rk GROUP BY ALL
    UNION ALL SELECT cutoff, ab, 'ranked', count(*) FROM rk GROUP BY ALL UNION ALL SELECT cutoff, ab, 'ece', sum(n * abs(mc - ob)) / sum(n) FROM bn GROUP BY ALL UNION ALL SELECT cutoff, ab, 'refusals_correct', count(*) FILTER (WHERE answer = 1 AND outcome = 'refused') FROM tp GROUP BY ALL),
  r AS (SELECT cutoff, ab, metric, round(coalesce(value, 0), 6) AS value FROM runs CROSS JOIN (SELECT DISTINCT metric FROM v) LEFT JOIN v USING (cutoff, ab, metric))"""


def matrix(spark: SparkSession, d: str) -> DataFrame:
    weight, every = F.col("weight"), F.lit(True)
    slots = {"full system": (weight, every), "no method signature": (F.lit(1.0), every), "no belief revision": (None, every), "no literature": (weight, F.col("kind") != "literature")}
    at = (F.col("entity") % 5 + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), at)
    names, weights = zip(*ROUTES)
    e = slices.asof(evidence(spark, d), CUTS)
    return build.run_matrix(e, established(spark, d), trap_rows(spark, d).drop("passed", "vacuous"), truth_by_cutoff(spark, d).select("cutoff", "entity"), slots, ["cutoff"], pick(names), pick(weights))


@query("c15_effects", f"{_MATRIX} SELECT CAST(r.cutoff AS VARCHAR) AS cutoff, r.ab AS ablation, metric, r.value, f.value AS full_value, CASE WHEN abs(r.value - f.value) <= 0.002 THEN 'same' WHEN r.value > f.value THEN 'better' ELSE 'worse' END AS effect FROM r JOIN (SELECT cutoff, metric, value FROM r WHERE ab = 'full system') f USING (cutoff, metric)")
def c15_effects(spark: SparkSession, d: str) -> DataFrame:
    shown = matrix(spark, d).filter(F.col("metric").isin("p_at_5", "p_at_10", "reciprocal_rank", "ranked", "ece", "refusals_correct"))
    return build.effects(shown.withColumn("value", F.round("value", 6)), whole="full system").withColumn("cutoff", F.col("cutoff").cast("string"))


@query("a07_modality_rules", f"""WITH {_JOB}, {_CLAIMS}, named AS (SELECT cutoff, entity, record FROM w WHERE assay = 'A' AND p < 0.005 UNION SELECT w.cutoff, w.entity, record FROM w SEMI JOIN ess USING (cutoff, entity) WHERE phenotype = 'cell_fitness'
    UNION SELECT cutoff, entity, record FROM w WHERE phenotype <> 'cell_fitness' AND assay <> 'A' UNION SELECT cutoff, entity, record FROM used WHERE k <= 400 UNION SELECT cutoff, entity, best_record FROM com),
  ids AS (SELECT cutoff, entity, list(id ORDER BY id) AS ids FROM (SELECT cutoff, entity, CAST(record AS VARCHAR) AS id, row_number() OVER (PARTITION BY cutoff, entity ORDER BY CAST(record AS VARCHAR)) AS place FROM named) WHERE place <= 50 GROUP BY ALL)
SELECT cutoff, entity, 'rule:modality:' || entity AS rule_id, route, len(ids) AS records, array_to_string(ids, ',') AS record_ids FROM claims JOIN ids USING (cutoff, entity)""")
def a07(spark: SparkSession, d: str) -> DataFrame:
    found, _ = rule_set(spark, d)
    rows = derive.modality_support(found.records, found.routes, ["cutoff"])
    return rows.select("cutoff", "entity", "rule_id", "route", F.size("record_ids").cast("long").alias("records"), F.array_join("record_ids", ",").alias("record_ids"))


@query("c10_revise_beliefs", f"""WITH {_JOB}, {_CLAIMS} SELECT cutoff, entity, route, publications, evidence, round(z, 6) AS log_odds, round(confidence, 6) AS confidence, max_support, max_composition, reportable FROM said""")
def c10(spark: SparkSession, d: str) -> DataFrame:
    return beliefs(spark, d).select("cutoff", "entity", "route", "publications", "evidence", "log_odds", "confidence", "max_support", "max_composition", "reportable")


@query("u02_union_evidence", f"WITH {_JOB} SELECT cutoff, kind, count(*) AS n, count(DISTINCT entity) AS entities, round(sum(delta) / 0.85, 3) AS weight FROM ev GROUP BY ALL")
def u02(spark: SparkSession, d: str) -> DataFrame:
    found, t = rule_set(spark, d)
    rows = jobs.gather_evidence(found, t["publications"], ["cutoff"], "A", P_MOST)
    return rows.groupBy("cutoff", "kind").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"), F.round(F.sum(F.col("direction") * F.col("weight")), 3).alias("weight"))


@query("j11_directness", "SELECT p_type AS phenotype, CASE p_type WHEN 'ECONOMY' THEN 'direct_protein' WHEN 'PROMO' THEN 'transcript' ELSE 'proxy' END AS directness, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def j11(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_type").alias("phenotype"))
    kinds = spark.createDataFrame([("ECONOMY", "direct_protein"), ("PROMO", "transcript"), ("OTHER", "transcript")], "phenotype string, directness string")
    return weigh.directness_of(rows, kinds).groupBy("phenotype", "directness").agg(F.count("*").alias("n"))


@query("j13_uniform_weight", f"WITH {_JOB}, {_CLAIMS} SELECT cutoff, count(*) AS n, CAST(count(*) AS DOUBLE) AS weight FROM m GROUP BY cutoff")
def j13(spark: SparkSession, d: str) -> DataFrame:
    t = tables(spark, d)
    return jobs.weighed_rows(t["measurements"], t["phenotypes"], ["cutoff"], P_MOST, OPTIONS["tables"], uniform=True).groupBy("cutoff").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


_HELD = f"""left_ev AS (SELECT cutoff, entity, delta, NULL AS transferred FROM papers UNION ALL SELECT cutoff, entity, transferred * 0.85, transferred FROM routed),
  without AS (SELECT cutoff, entity, 1 / (1 + exp(-({_PRIOR} + sum(delta)))) AS c2, count(*) AS e2, max(transferred) AS t2 FROM left_ev GROUP BY ALL),
  tested AS (SELECT h.cutoff, h.entity, h.hidden, coalesce(s.confidence, 0) AS c1, coalesce(s.reportable, false) AS r1, coalesce(c2, 0) AS c2, coalesce(e2, 0) AS e2, coalesce(round(c2, 6) >= 0.25 AND (coalesce(tiers, 0) >= 5 OR coalesce(t2, 0) >= 0.25), false) AS r2
    FROM (SELECT cutoff, entity, count(*) AS hidden FROM m GROUP BY ALL HAVING count(*) >= 2) h LEFT JOIN said s ON s.cutoff = h.cutoff AND s.entity = h.entity LEFT JOIN without x ON x.cutoff = h.cutoff AND x.entity = h.entity LEFT JOIN lit ON lit.cutoff = h.cutoff AND lit.entity = h.entity)"""


def held_out(spark: SparkSession, d: str) -> DataFrame:
    t = tables(spark, d)
    labels = read(spark, d, "part").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("label"))
    return jobs.hold_out(**t, keys=["cutoff"], labels=labels, most=None, **OPTIONS)


@query("j28_holdout_compare", f"WITH {_JOB}, {_CLAIMS}, {_HELD} SELECT cutoff, entity, hidden, round(c1, 6) AS confidence, r1 AS reportable, round(c2, 6) AS confidence_without, r2 AS reportable_without, e2 AS evidence_without FROM tested")
def j28(spark: SparkSession, d: str) -> DataFrame:
    return held_out(spark, d).select("cutoff", "entity", "hidden", "confidence", "reportable", "confidence_without", "reportable_without", "evidence_without")


@query("c19_holdout_recovery", f"WITH {_JOB}, {_CLAIMS}, {_HELD} SELECT cutoff, count(*) AS tested, count(*) FILTER (WHERE r2) AS recovered, round(avg(c1 - c2), 4) AS mean_drop, round(count(*) FILTER (WHERE r2) / count(*), 6) AS rate FROM tested WHERE r1 GROUP BY cutoff")
def c19(spark: SparkSession, d: str) -> DataFrame:
    return grade.holdout_report(held_out(spark, d), ["cutoff"]).select("cutoff", "tested", "recovered", F.round("mean_drop", 4).alias("mean_drop"), F.round("rate", 6).alias("rate"))


_CARD = f"""{_TRAPS}, {_HITS}, r AS (SELECT ranked.cutoff, ranked.entity, ranked.rank, ranked.cost_rank, h.entity IS NOT NULL AS hit FROM ranked LEFT JOIN hits h USING (cutoff, entity)),
  b AS (SELECT cutoff, least(CAST(floor(confidence * 5) AS INT), 4) AS bin, count(*) AS n, avg(confidence) AS mc, avg(CASE WHEN h.entity IS NOT NULL THEN 1.0 ELSE 0.0 END) AS ob FROM decided LEFT JOIN hits h USING (cutoff, entity) WHERE outcome <> 'established' GROUP BY 1, 2),
  refused AS (SELECT t.cutoff, count(*) AS total, count(*) FILTER (WHERE outcome = 'refused') AS correct FROM t LEFT JOIN decided USING (cutoff, entity) WHERE answer = 'refuse' GROUP BY 1),
  rk AS (SELECT cutoff, count(*) FILTER (WHERE hit AND rank <= 5) / 5 AS p_at_5, count(*) FILTER (WHERE hit AND rank <= 10) / 10 AS p_at_10, coalesce(1 / min(CASE WHEN hit THEN rank END), 0) AS reciprocal_rank, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) AS hits, CAST(count(*) AS DOUBLE) AS ranked,
    count(*) FILTER (WHERE hit AND cost_rank <= 5) / 5 AS cost_p_at_5, count(*) FILTER (WHERE hit AND cost_rank <= 10) / 10 AS cost_p_at_10, coalesce(1 / min(CASE WHEN hit THEN cost_rank END), 0) AS cost_reciprocal_rank, CAST(count(*) FILTER (WHERE rank <> cost_rank) AS DOUBLE) AS cost_lens_moved FROM r GROUP BY cutoff),
  tr AS (SELECT cutoff, CAST(count(*) FILTER (WHERE passed) AS DOUBLE) AS traps_passed, CAST(count(*) FILTER (WHERE passed AND vacuous) AS DOUBLE) AS traps_vacuous, CAST(count(*) FILTER (WHERE passed AND NOT vacuous) AS DOUBLE) AS traps_meaningful, CAST(count(*) FILTER (WHERE kind <> 'postdates_cutoff') AS DOUBLE) AS traps_judgement_total,
    CAST(count(*) FILTER (WHERE kind <> 'postdates_cutoff' AND passed AND NOT vacuous) AS DOUBLE) AS traps_judgement, CAST(count(*) FILTER (WHERE kind = 'postdates_cutoff') AS DOUBLE) AS traps_contamination_total, CAST(count(*) FILTER (WHERE kind = 'postdates_cutoff' AND passed) AS DOUBLE) AS traps_contamination FROM o GROUP BY cutoff),
  card AS (SELECT cutoff, metric, value FROM (UNPIVOT rk ON COLUMNS(* EXCLUDE (cutoff)) INTO NAME metric VALUE value) UNION ALL SELECT cutoff, metric, value FROM (UNPIVOT tr ON COLUMNS(* EXCLUDE (cutoff)) INTO NAME metric VALUE value)
    UNION ALL SELECT cutoff, 'ece', sum(n * abs(mc - ob)) / sum(n) FROM b GROUP BY cutoff UNION ALL SELECT cutoff, 'refusals_total', total FROM refused UNION ALL SELECT cutoff, 'refusals_correct', correct FROM refused)"""


def card(spark: SparkSession, d: str) -> DataFrame:
    return jobs.scorecard(decided(spark, d), ranked(spark, d), truth_by_cutoff(spark, d), trap_rows(spark, d).drop("passed", "vacuous"), ["cutoff"]).withColumn("cutoff", F.col("cutoff").cast("string"))


@query("c14_grade", f"{_CARD} SELECT CAST(cutoff AS VARCHAR) AS cutoff, metric, round(value, 5) AS value FROM card")
def c14(spark: SparkSession, d: str) -> DataFrame:
    return card(spark, d).withColumn("value", F.round("value", 5))


_SHOWN = "p_at_5 reciprocal_rank traps_judgement never_run".split()


@query("c21_scorecard_tables", f"""{_CARD}, k AS (SELECT DISTINCT cutoff FROM card)
SELECT CAST(cutoff AS VARCHAR) AS cutoff, 'full' AS run, {", ".join(f"coalesce((SELECT printf('%.3f', value) FROM card WHERE card.cutoff = k.cutoff AND metric = '{m}'), 'not run') AS {m}" for m in _SHOWN)} FROM k""")
def c21(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("double")
    return build.scorecard(card(spark, d).withColumns({"run": F.lit("full"), "lower": none, "upper": none}), _SHOWN)


_SAID = """v AS (SELECT cutoff, entity, confidence, CASE WHEN outcome = 'established' THEN 'known' WHEN outcome = 'forecast' AND h.entity IS NOT NULL THEN 'hit' WHEN outcome = 'forecast' THEN 'forecast' WHEN h.entity IS NOT NULL THEN 'missed' WHEN outcome = 'refused' THEN 'refused' ELSE 'none' END AS verdict FROM decided LEFT JOIN (SELECT DISTINCT cutoff, entity FROM hits) h USING (cutoff, entity)),
  g AS (SELECT *, lag(verdict) OVER (PARTITION BY entity ORDER BY cutoff) AS before FROM v)"""


@query("c22_gene_tables", f"""{_BASE}, {_HITS}, {_SAID} SELECT entity, string_agg(CAST(cutoff AS VARCHAR) || '=' || verdict, ' ' ORDER BY cutoff) AS steps, count(*) FILTER (WHERE before <> verdict) AS changes,
  arg_min(verdict, list_position(['hit', 'forecast', 'missed', 'known', 'refused', 'none'], verdict)) AS best, max(confidence) AS top_confidence FROM g GROUP BY entity""")
def c22(spark: SparkSession, d: str) -> DataFrame:
    t = truth_by_cutoff(spark, d).select("cutoff", "entity", F.lit(True).alias("true"))
    rows = decided(spark, d).join(t, ["cutoff", "entity"], "left").fillna(False, ["true"])
    is_ = lambda o: F.col("outcome") == o
    out = jobs.gene_tables(rows.select("cutoff", "entity", "confidence", rules.verdict(is_("established"), is_("forecast"), is_("refused"), F.col("true")).alias("verdict")))
    return out.withColumn("steps", F.array_join(F.transform("steps", lambda s: F.concat(s["cutoff"].cast("string"), F.lit("="), s["verdict"])), " "))


def said(spark: SparkSession, d: str) -> DataFrame:
    """What each slice says about an entity, and what is only true of it: cutoff, entity, outcome, evidence, confidence, true."""
    t = truth_by_cutoff(spark, d).select("cutoff", "entity", F.lit(True).alias("true"))
    return decided(spark, d).select("cutoff", "entity", "outcome", "evidence", "confidence").join(t, ["cutoff", "entity"], "full").fillna(False, ["true"])


@query("c22_gene_index", f"""{_BASE}, {_HITS}, every AS (SELECT entity FROM decided UNION SELECT entity FROM truth UNION SELECT user_id FROM events),
  w AS (SELECT e.entity, cuts.cutoff, outcome, h.entity IS NOT NULL AS hit, coalesce(outcome, '') AS oc FROM every e CROSS JOIN cuts LEFT JOIN decided d ON d.entity = e.entity AND d.cutoff = cuts.cutoff LEFT JOIN (SELECT DISTINCT cutoff, entity FROM hits) h ON h.entity = e.entity AND h.cutoff = cuts.cutoff)
SELECT w.entity, CAST(any_value(established) AS VARCHAR) AS established, w.entity % 6 IN (1, 4) AS trapped, coalesce(string_agg(CAST(cutoff AS VARCHAR), ',' ORDER BY cutoff) FILTER (WHERE oc = 'forecast'), '') AS forecast_at, coalesce(string_agg(CAST(cutoff AS VARCHAR), ',' ORDER BY cutoff) FILTER (WHERE hit), '') AS truth_at,
  string_agg(CASE WHEN oc = 'established' THEN 'known' WHEN oc = 'forecast' AND hit THEN 'hit' WHEN oc = 'forecast' THEN 'forecast' WHEN hit THEN 'missed' WHEN oc = 'refused' THEN 'refused' ELSE 'none' END, ',' ORDER BY cutoff) AS verdicts
FROM w LEFT JOIN truth ON truth.entity = w.entity GROUP BY w.entity""")
def c22_index(spark: SparkSession, d: str) -> DataFrame:
    users = read(spark, d, "events").select(F.col("user_id").alias("entity"))
    book = users.distinct().join(established(spark, d).select("entity", "established"), "entity", "left")  # every user is in the book
    out = jobs.gene_index(said(spark, d), users.filter("user_id % 6 IN (1, 4)"), book, CUTS)
    return out.withColumns({"established": F.col("established").cast("string")} | {c: F.array_join(c, ",") for c in ("forecast_at", "truth_at", "verdicts")})


@query("c22_evidence_points", f"{_BASE}, {_HITS}, {_SAID} SELECT CAST(v.cutoff AS VARCHAR) AS cutoff, v.entity, evidence, v.confidence, verdict FROM v JOIN decided USING (cutoff, entity) WHERE outcome IN ('forecast', 'refused')")
def c22_points(spark: SparkSession, d: str) -> DataFrame:
    return jobs.evidence_points(said(spark, d)).withColumn("cutoff", F.col("cutoff").cast("string"))


_ABLATED = "ranked refusals_correct p_at_5 p_at_10 reciprocal_rank ece never_run".split()


@query("c21_ablation_table", f"""{_MATRIX} SELECT ab AS ablation, {", ".join(f"coalesce(max(CASE WHEN metric = '{m}' THEN printf('%.3f', round(value, 3)) END), 'not run') AS {m}" for m in _ABLATED)} FROM r WHERE cutoff = DATE '{CUTS[1]}' GROUP BY ab""")
def c21_ablations(spark: SparkSession, d: str) -> DataFrame:
    return build.ablation_table(matrix(spark, d).withColumn("cutoff", F.col("cutoff").cast("string")), CUTS[1], _ABLATED)


@query("c21_trap_table", f"""{_TRAPS} SELECT CAST(o.cutoff AS VARCHAR) AS cutoff, o.entity, o.kind, o.answer AS correct_answer, CASE x.outcome WHEN 'forecast' THEN 'accept' WHEN 'refused' THEN 'refuse' ELSE 'absent' END AS system_answer,
  CASE WHEN NOT passed THEN 'FAIL' WHEN o.kind = 'postdates_cutoff' THEN 'pass (contamination check)' WHEN vacuous THEN 'pass (vacuous)' ELSE 'pass' END AS result FROM o LEFT JOIN (SELECT cutoff, entity, outcome FROM decided) x ON x.cutoff = o.cutoff AND x.entity = o.entity""")
def c21_traps(spark: SparkSession, d: str) -> DataFrame:
    return build.trap_table(trap_rows(spark, d), decided(spark, d), ["cutoff"]).withColumn("cutoff", F.col("cutoff").cast("string"))


@query("c21_reliability_table", f"{_BINS} SELECT CAST(cutoff AS VARCHAR) AS cutoff, printf('%.1f to %.1f', bin * 0.2, (bin + 1) * 0.2) AS confidence_bin, n AS claims, printf('%.3f', round(mean_confidence, 3)) AS mean_confidence, printf('%.3f', round(observed, 3)) AS observed FROM bins")
def c21_reliability(spark: SparkSession, d: str) -> DataFrame:
    bins = grade.calibration_bins(scored(spark, d), ["cutoff"])
    return build.reliability_table(bins, ["cutoff"], 0.2).withColumn("cutoff", F.col("cutoff").cast("string"))


_LINES = "x AS (SELECT l_partkey AS entity, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS record, CAST(l_shipdate AS DATE) AS date, l_returnflag AS assay, l_tax > 0.055 AS paper FROM lineitem)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return read(spark, d, "lineitem").select(c("l_partkey").alias("entity"), ((c("l_orderkey") * 10 + c("l_linenumber")) * 100_000 + c("l_suppkey")).alias("record"), c("l_shipdate").cast("date").alias("date"), c("l_returnflag").alias("assay"), (c("l_tax") > 0.055).alias("paper"))


@query("c23_graph_profile", f"""WITH {_LINES} SELECT p_partkey AS entity, coalesce((SELECT string_agg(assay || '=' || n, ' ' ORDER BY assay) FROM (SELECT assay, count(*) AS n FROM x WHERE NOT paper AND x.entity = p_partkey GROUP BY assay)), '') AS by_assay, (SELECT count(*) FROM x WHERE NOT paper AND x.entity = p_partkey) AS measurements,
  (SELECT count(*) FROM x WHERE paper AND x.entity = p_partkey) AS publications, (SELECT count(*) FROM part q WHERE q.p_partkey // 4 = part.p_partkey // 4 AND q.p_partkey <> part.p_partkey) AS partners,
  (SELECT arg_min(record, (-epoch(date), record)) FROM x WHERE NOT paper AND x.entity = p_partkey) AS latest_measurement, (SELECT arg_min(record, (-epoch(date), record)) FROM x WHERE paper AND x.entity = p_partkey) AS latest_publication FROM part""")
def c23(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d)
    out = jobs.profile(x.filter("NOT paper"), x.filter("paper"), part_pairs(spark, d), read(spark, d, "part").select(F.col("p_partkey").alias("entity")))
    shown = F.array_join(F.transform(F.map_entries("by_assay"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    return out.withColumn("by_assay", F.coalesce(shown, F.lit("")))


@query("t03_latest_publications", f"WITH {_LINES} SELECT entity, record, place, total FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC, record) AS place, count(*) OVER (PARTITION BY entity) AS total FROM x WHERE paper) WHERE place <= 20")
def t03(spark: SparkSession, d: str) -> DataFrame:
    return longs(graph.latest(lines(spark, d).filter("paper"), "entity", "date", "record").select("entity", "record", "place", "total"), "place")


@query("t08_refusals", f"{_BASE} SELECT CAST(cutoff AS VARCHAR) AS cutoff, entity, confidence FROM decided WHERE outcome = 'refused'")
def t08(spark: SparkSession, d: str) -> DataFrame:
    out = forecast.ranked_claims(decided(spark, d).withColumn("symbol", F.col("entity").cast("string")), "refused")
    return out.select(F.col("cutoff").cast("string").alias("cutoff"), "entity", "confidence")


_ANSWER = "claims array<struct<gene_symbol:string,confidence:double,cited_ids:array<string>>>, refusals array<struct<gene_symbol:string,reason:string>>"


@query("c18_score_answers", """WITH a AS (SELECT o_custkey AS run, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
  s AS (SELECT run, CASE WHEN run % 5 = 0 THEN 'not the schema' WHEN run % 5 = 1 THEN 'confidence outside 0..1' WHEN run % 5 = 2 OR run % 13 = 6 OR n > 200 THEN 'two answers for a gene' ELSE 'ok' END AS status FROM (SELECT DISTINCT run, n FROM a)),
  c AS (SELECT run, k, pos, (run + pos * 7) % 200 + 1 AS part, (k % 97) / 100 AS confidence FROM a SEMI JOIN (SELECT run FROM s WHERE status = 'ok') USING (run)),
  e AS (SELECT c.*, p_partkey IS NOT NULL AS known, CASE WHEN p_partkey IS NOT NULL OR pos % 2 = 0 THEN 'p' || part ELSE 'alias_' || part END AS symbol FROM c LEFT JOIN part ON p_partkey = part),
  r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY confidence DESC, pos) AS rank, known AND part % 3 = 0 AS hit FROM e),
  node AS (SELECT o_orderkey AS id, o_orderdate < DATE '1997-01-01' AS sliced, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS shown, o_orderkey % 3 = 0 AS measured, (o_custkey + o_orderkey % 3 * 7) % 200 + 1 AS own FROM orders),
  q AS (SELECT r.run, r.part, sliced AND shown IS NOT DISTINCT FROM r.run AND shown IS NOT NULL AS in_context, coalesce(sliced, false) AS sliced, id IS NOT NULL AS stored, CASE WHEN measured THEN known AND own = part ELSE symbol = 'p' || own END AS names
    FROM r CROSS JOIN (SELECT unnest([0, 1]) AS step) LEFT JOIN node ON id = k + step),
  g AS (SELECT run, part FROM q WHERE in_context AND names GROUP BY ALL),
  cites AS (SELECT run, count(*) AS citations, count(*) FILTER (WHERE in_context) AS in_context, count(*) FILTER (WHERE sliced AND NOT in_context) AS out_of_context, count(*) FILTER (WHERE stored AND NOT sliced) AS post_cutoff, count(*) FILTER (WHERE NOT stored) AS fabricated FROM q GROUP BY run),
  traps AS (SELECT run, part, answer, rank FROM (SELECT run, unnest([0, 1]) AS i FROM s WHERE status = 'ok') t JOIN LATERAL (SELECT (run + i * 7) % 200 + 1 AS part, CASE WHEN i = 0 THEN 'reject' ELSE 'refuse' END AS answer) ON true LEFT JOIN (SELECT run, part, rank FROM r WHERE known) USING (run, part)),
  tr AS (SELECT run, count(*) AS traps, count(*) FILTER (WHERE CASE WHEN answer = 'reject' THEN rank IS NULL OR rank > 10 ELSE rank IS NULL END) AS traps_passed FROM traps GROUP BY run),
  m AS (SELECT run, count(*) FILTER (WHERE hit AND rank <= 5) / 5 AS p_at_5, coalesce(round(1 / min(CASE WHEN hit THEN rank END), 6), 0) AS reciprocal_rank, count(*) AS ranked, count(*) FILTER (WHERE g.part IS NOT NULL) AS grounded_claims, count(*) FILTER (WHERE hit) AS post_cutoff_claims, count(*) FILTER (WHERE hit AND g.part IS NULL) AS recalled
    FROM r LEFT JOIN g USING (run, part) GROUP BY run)
SELECT s.run, status, coalesce(p_at_5, 0) AS p_at_5, coalesce(reciprocal_rank, 0) AS reciprocal_rank, coalesce(ranked, 0) AS ranked, CASE WHEN status = 'ok' THEN 1 ELSE 0 END AS refusals, coalesce(citations, 0) AS citations, coalesce(in_context, 0) AS in_context, coalesce(out_of_context, 0) AS out_of_context,
  coalesce(post_cutoff, 0) AS post_cutoff, coalesce(fabricated, 0) AS fabricated, coalesce(grounded_claims, 0) AS grounded_claims, coalesce(post_cutoff_claims, 0) AS post_cutoff_claims, coalesce(recalled, 0) AS recalled, coalesce(traps, 0) AS traps, coalesce(traps_passed, 0) AS traps_passed
FROM s LEFT JOIN m USING (run) LEFT JOIN cites USING (run) LEFT JOIN tr USING (run)""")
def c18(spark: SparkSession, d: str) -> DataFrame:
    # An order is a claim of its customer's answer, which cites the order and the next number; every other name is an alias
    # of the part. A customer is shown its orders of even numbers. Part 200 may not be in the table: its name stays unresolved.
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("k"), "o_orderdate")
    rows = orders.groupBy("run").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    part = lambda i: ((F.col("run") + i * 7) % 200 + 1).cast("string")
    cites = lambda k: F.array(k.cast("string"), (k + 1).cast("string"))
    name = lambda i: F.concat(F.when(i % 2 == 0, " p").otherwise("alias_"), part(i))
    claims = F.transform("ks", lambda k, i: F.struct(name(i).alias("gene_symbol"), F.when((F.col("run") % 5 == 1) & (i == 0), 1.5).otherwise((k % 97) / 100).alias("confidence"), cites(k).alias("cited_ids")))
    none = F.array().cast("array<string>")
    twice = F.array(*[F.struct(F.concat(F.lit(p), part(F.lit(0))).alias("gene_symbol"), F.lit(c).alias("confidence"), none.alias("cited_ids")) for p, c in (("P", 0.5), ("p", 0.25))])
    refused = F.array(F.struct(F.when(F.col("run") % 13 == 6, F.concat(F.lit("p"), part(F.lit(0)))).otherwise(F.concat(F.lit("nobody"), F.col("run").cast("string"))).alias("gene_symbol"), F.lit("no evidence").alias("reason")))
    told = F.to_json(F.struct(F.when(F.col("run") % 5 == 2, twice).otherwise(claims).alias("claims"), refused.alias("refusals")))
    answers = rows.select("run", F.when(F.col("run") % 5 == 0, "no json").otherwise(told).alias("answer"))
    truth = rows.select("run", F.explode(F.transform(F.sequence(F.lit(1), F.lit(66)), lambda i: (i * 3).cast("long"))).alias("entity"))
    record, own = F.col("k").cast("string").alias("record_id"), (F.col("run") + F.col("k") % 3 * 7) % 200 + 1
    nodes = orders.filter("o_orderdate < DATE '1997-01-01'").select(record, F.when(F.col("k") % 3 == 0, "Measurement").otherwise("Publication").alias("kind"), own.alias("own"), none.alias("matched"), F.concat(F.lit("The role of p"), own.cast("string"), F.lit(" here")).alias("title"))
    library = jobs.Library(orders.filter("k % 2 = 0").select("run", record), nodes, orders.select(record))
    decoys = rows.select("run", F.explode(F.array(*[F.struct(part(F.lit(i)).alias("entity"), F.lit(kind).alias("kind"), F.lit(answer).alias("answer")) for i, kind, answer in ((0, "association", "reject"), (1, "postdates_cutoff", "refuse"))])).alias("t")).select("run", "t.*")
    _, report = jobs.score_answers(answers, _ANSWER, part_entities(spark, d), truth, ["run"], library, decoys)
    return report.select("run", "status", "p_at_5", F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "ranked", "refusals", "citations", "in_context", "out_of_context", "post_cutoff", "fabricated", "grounded_claims", "post_cutoff_claims", "recalled", "traps", "traps_passed")


_PLANTED = """x AS (SELECT l_partkey AS entity, l_discount + 0.001 AS p, l_suppkey, l_quantity AS q, CAST(l_orderkey AS VARCHAR) AS record FROM lineitem), known AS (SELECT p_partkey AS entity FROM part WHERE p_size > 25),
  strong AS (SELECT x.* FROM x ANTI JOIN known USING (entity) WHERE p < 0.005), dead AS (SELECT entity FROM x GROUP BY entity HAVING count(*) >= 10 AND count(*) FILTER (WHERE q > 20) >= 0.7 * count(*)),
  firsts AS (SELECT kind, entity, list(record ORDER BY record) AS records FROM (SELECT *, row_number() OVER (PARTITION BY kind, entity ORDER BY record) AS place FROM (SELECT DISTINCT 'association' AS kind, entity, record FROM strong UNION SELECT 'essential', entity, record FROM x SEMI JOIN dead USING (entity))) WHERE place <= 10 GROUP BY ALL),
  planted AS (SELECT entity, 'association' AS kind, 'reject' AS answer, round(min(p), 6) AS number, count(*) AS n FROM strong GROUP BY entity UNION ALL SELECT entity, 'essential', 'reject', round(count(*) FILTER (WHERE q > 20) / count(*), 4), count(*) FROM x SEMI JOIN dead USING (entity) GROUP BY entity
    UNION ALL SELECT p_partkey, 'postdates_cutoff', 'refuse', 365, 0 FROM part WHERE p_size > 40 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O'))"""


def planted(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    x = read(spark, d, "lineitem").select(c("l_partkey").alias("entity"), (c("l_discount") + 0.001).alias("p"), c("l_suppkey").alias("accession"), c("l_orderkey").alias("record"), (-c("l_quantity")).alias("effect"), "l_linestatus")
    part = read(spark, d, "part").select(c("p_partkey").alias("entity"), "p_size")
    when = part.filter("p_size > 40").select("entity", F.lit("2000-01-01").cast("date").alias("established"))
    counts = x.filter("l_linestatus = 'O'").groupBy("entity").agg(F.count("*").alias("measurements"), F.lit(0).alias("publications"))
    return traps.plant(x, part.filter("p_size > 25"), x, when, counts, "1999-01-01", P_MOST, 10, -20.5)


@query("c13_plant_traps", f"WITH {_PLANTED} SELECT entity, kind, answer, coalesce(array_to_string(records, ','), '') AS records, CAST(number AS DOUBLE) AS number, CAST(n AS DOUBLE) AS n FROM planted LEFT JOIN firsts USING (kind, entity)")
def c13(spark: SparkSession, d: str) -> DataFrame:
    number, n = (F.coalesce(*[F.try_element_at("numbers", F.lit(x)) for x in names]) for names in (("best_p", "fraction", "days_after"), ("n", "lines", "measurements")))
    return planted(spark, d).select("entity", "kind", "answer", F.array_join("records", ",").alias("records"), F.round(number, 6).alias("number"), n.alias("n"))


@query("c13_trace_traps", f"WITH {_PLANTED}, ids AS (SELECT kind || entity AS object, unnest(records) AS id FROM planted JOIN firsts USING (kind, entity)) SELECT (SELECT count(*) FROM planted) AS objects, count(*) AS ids, count(*) FILTER (WHERE o_orderkey IS NULL) AS untraceable, count(*) FILTER (WHERE o_orderkey IS NOT NULL AND o_orderpriority = '5-LOW') AS unlicensed FROM ids LEFT JOIN orders ON CAST(o_orderkey AS VARCHAR) = id")
def c13_trace(spark: SparkSession, d: str) -> DataFrame:
    # J19 over every trap: the records it names against the orders, of which the least urgent have no licence
    nodes = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderpriority") != "5-LOW", "CC0").alias("license"))
    return grade.trace_records(planted(spark, d).select(F.concat("kind", F.col("entity").cast("string")).alias("object"), F.col("records").alias("record_ids")), nodes)


@query("a14_loaded_rates", """WITH n AS (SELECT l_linestatus || l_linenumber AS source, l_orderkey, CASE WHEN l_linenumber <> 7 THEN 's' END AS sid, l_tax < 0.02 AS bare, l_quantity > 45 AS empty FROM lineitem WHERE l_returnflag <> 'R'),
  a AS (SELECT l_linestatus || l_linenumber AS source, count(*) AS available FROM lineitem GROUP BY ALL UNION ALL SELECT 'NONE', 0), l AS (SELECT source, count(*) AS loaded, count(*) FILTER (WHERE sid IS NULL OR bare) + count(*) FILTER (WHERE empty) AS spurious FROM n GROUP BY source)
SELECT source, available, coalesce(loaded, 0) AS loaded, coalesce(spurious, 0) AS spurious, CASE WHEN available > 0 THEN round(coalesce(loaded, 0) / available, 6) ELSE 0 END AS rate FROM a LEFT JOIN l USING (source)""")
def a14_rates(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    lines = read(spark, d, "lineitem").withColumn("source", F.concat("l_linestatus", c("l_linenumber").cast("string")))
    nodes = lines.filter("l_returnflag <> 'R'").select("source", F.lit("Measurement").alias("type"), F.when(c("l_linenumber") != 7, "s").alias("source_id"), F.when(c("l_tax") >= 0.02, "CC0").otherwise("").alias("license"), F.when(c("l_quantity") <= 45, c("l_quantity")).alias("value"))
    available = lines.groupBy("source").agg(F.count("*").alias("n")).union(spark.range(1).select(F.lit("NONE"), F.lit(0).cast("long")))
    return merge.loaded_rates(available, nodes, merge.spurious_rows(nodes))


@query("u06_merge_reports", "SELECT l_returnflag AS counter, count(*) + count(*) FILTER (WHERE l_linestatus = 'O') AS n, 'first:' || l_returnflag || CASE WHEN count(*) FILTER (WHERE l_linestatus = 'O') > 0 THEN ',second:' || l_returnflag ELSE '' END AS findings FROM lineitem GROUP BY l_returnflag")
def u06(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem")
    report = lambda t, name: t.groupBy(F.col("l_returnflag").alias("counter")).agg(F.count("*").alias("n")).withColumn("findings", F.array(F.concat(F.lit(f"{name}:"), "counter")))
    return merge.merge_reports(report(x, "first"), report(x.filter("l_linestatus = 'O'"), "second")).withColumn("findings", F.array_join("findings", ","))


@query("u07_candidate_difference", f"WITH {_EV} SELECT DISTINCT entity FROM ev WHERE entity NOT IN (SELECT entity FROM ev WHERE event_type = 'purchase' AND value > 200)")
def u07(spark: SparkSession, d: str) -> DataFrame:
    return merge.difference(read(spark, d, "events").select(F.col("user_id").alias("entity")), established(spark, d).select("entity"))


@query("j25_read_back", "SELECT (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey + 50) AS found, (SELECT count(*) FROM orders ANTI JOIN customer ON c_custkey = o_custkey + 50) AS leaks")
def j25(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "orders").select((F.col("o_custkey") + 50).alias("id"))
    rows, missing = merge.read_back(asked, read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name"))
    return rows.select(F.lit(1).alias("found"), F.lit(0).alias("leaks")).union(missing.select(F.lit(0), F.lit(1))).agg(F.sum("found").alias("found"), F.sum("leaks").alias("leaks"))
