"""The operators over the driver's tables, each beside the DuckDB SQL that gives the same rows.

Roles: ``events`` is dated evidence about users; ``orders``, ``lineitem``, ``part``, ``supplier`` and ``customer`` are a
dated graph; ``lineitem`` rows are also measurements of parts; texts come from ``documents``, ``benchmark`` and ``pages``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import policy
from tidemark.functions import rules, scalars, text
from tidemark.operators import derive, forecast, grade, graph, ingest, ledger, merge, resolve, retrieval, slices, traps, weigh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


CUTS = ["2024-01-10", "2024-01-20", "2024-02-01"]
GRAPH_CUTS = ["1996-01-01", "1998-01-01", "2000-01-01"]
ROUTES = list(policy.ROUTE_WEIGHTS.items())
KINDS = {"purchase": "measurement", "click": "genetic", "view": "literature", "signup": "composition", "error": "measurement"}


def evidence(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(F.col("user_id").alias("entity"), F.col("ts").cast("date").alias("date"), F.col("ts").cast("date").alias("effective_date"), F.col("event_id").alias("record"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("direction"), (F.col("value") / 997).alias("weight"), ((F.col("event_type") == "purchase") | ((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0))).alias("tier"), rules.lookup(KINDS, F.col("event_type"), "literature").alias("kind"), "event_type", "value")


def established(spark: SparkSession, d: str) -> DataFrame:
    e = evidence(spark, d).filter("event_type = 'purchase' AND value > 200")
    return e.groupBy("entity").agg(F.min("date").alias("established"))


_PRIOR = repr(ledger.PRIOR)
_CUTS = "cuts(cutoff) AS (VALUES " + ", ".join(f"(DATE '{c}')" for c in CUTS) + ")"
_GRAPH_CUTS = "cuts(cutoff) AS (VALUES " + ", ".join(f"(DATE '{c}')" for c in GRAPH_CUTS) + ")"
_KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " ELSE 'literature' END"
_EV = f"ev AS (SELECT user_id AS entity, CAST(ts AS DATE) AS date, event_id AS record, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS direction, value / 997 AS weight, event_type = 'purchase' OR (event_type = 'view' AND event_id % 2 = 0) AS tier, {_KIND} AS kind, event_type, value FROM events)"
_TRUTH = "truth AS (SELECT entity, min(date) AS established FROM ev WHERE event_type = 'purchase' AND value > 200 GROUP BY entity)"
_ROLL = f"""roll AS (SELECT cutoff, entity, round({_PRIOR} + sum(direction * weight * 0.85), 6) AS log_odds,
  round(1 / (1 + exp(-({_PRIOR} + sum(direction * weight * 0.85)))), 6) AS confidence, count(*) AS evidence,
  max(CASE WHEN direction > 0 AND kind IN ('measurement', 'genetic') THEN weight END) AS max_support,
  max(CASE WHEN direction > 0 AND kind = 'composition' THEN weight END) AS max_composition,
  count(*) FILTER (WHERE kind = 'literature' AND tier) AS publications, min(date) AS first_date, max(date) AS last_date, string_agg(record, ',' ORDER BY date, record) FILTER (WHERE direction > 0) AS supporting, string_agg(record, ',' ORDER BY date, record) FILTER (WHERE direction < 0) AS contradicting
  FROM ev JOIN cuts ON date < cutoff GROUP BY cutoff, entity)"""
_DECIDED = """decided AS (SELECT roll.*, CASE WHEN established < cutoff THEN 'established'
  WHEN confidence >= 0.25 AND (coalesce(max_support, 0) >= 0.30 OR publications >= 5 OR coalesce(max_composition, 0) >= 0.25) THEN 'forecast' ELSE 'refused' END AS outcome
  FROM roll LEFT JOIN truth USING (entity))"""
_ROUTE_W = "CASE entity % 5 " + " ".join(f"WHEN {i} THEN {w}" for i, (_, w) in enumerate(ROUTES)) + " END"
_ROUTE_N = "CASE entity % 5 " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(ROUTES)) + " END"
_RANKED = f"""scored AS (SELECT *, round(confidence * {_ROUTE_W}, 6) AS cost_score, {_ROUTE_N} AS route, CAST(entity AS VARCHAR) AS symbol FROM decided WHERE outcome = 'forecast'),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY cutoff ORDER BY confidence DESC, symbol) AS rank,
  row_number() OVER (PARTITION BY cutoff ORDER BY cost_score DESC, confidence DESC, symbol) AS cost_rank FROM scored)"""
_BASE = f"WITH {_EV}, {_CUTS}, {_TRUTH}, {_ROLL}, {_DECIDED}, {_RANKED}"


def rolled(spark: SparkSession, d: str) -> DataFrame:
    return ledger.roll_up(slices.asof(evidence(spark, d), CUTS), ["cutoff", "entity"])


def decided(spark: SparkSession, d: str) -> DataFrame:
    return forecast.decide(rolled(spark, d), established(spark, d), ["cutoff", "entity"])


def ranked(spark: SparkSession, d: str) -> DataFrame:
    items = decided(spark, d).filter("outcome = 'forecast'").withColumn("symbol", F.col("entity").cast("string"))
    at = (F.col("entity") % 5 + 1).cast("int")
    items = items.withColumn("route", F.element_at(F.array(*[F.lit(n) for n, _ in ROUTES]), at))
    return forecast.rank_two_ways(items, ["cutoff"], F.element_at(F.array(*[F.lit(w) for _, w in ROUTES]), at))


def graph_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    floor = F.lit("0001-01-01").cast("date")
    node = lambda t, prefix, c, kind, date: read(spark, d, t).select(name(prefix, c).alias("id"), F.lit(kind).alias("type"), date.alias("effective_date"))
    nodes = merge.union_all(node("orders", "o", "o_orderkey", "Order", F.col("o_orderdate").cast("date")), node("part", "p", "p_partkey", "Part", floor), node("customer", "c", "c_custkey", "Customer", floor))
    lines = read(spark, d, "lineitem").select(F.concat_ws(":", F.lit("l"), "l_orderkey", "l_partkey", "l_linenumber").alias("id"), F.lit("CONTAINS").alias("type"), name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst"), F.date_sub(F.col("l_shipdate").cast("date"), 60).alias("effective_date"))
    placed = read(spark, d, "orders").select(name("co", "o_orderkey").alias("id"), F.lit("PLACED").alias("type"), name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"), F.col("o_orderdate").cast("date").alias("effective_date"))
    return nodes, merge.union_all(lines, placed)


_GRAPH = f"""{_GRAPH_CUTS},
  nodes AS (SELECT 'o' || o_orderkey AS id, 'Order' AS type, CAST(o_orderdate AS DATE) AS effective_date FROM orders
    UNION ALL SELECT 'p' || p_partkey, 'Part', DATE '0001-01-01' FROM part UNION ALL SELECT 'c' || c_custkey, 'Customer', DATE '0001-01-01' FROM customer),
  edges AS (SELECT 'CONTAINS' AS type, 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, CAST(l_shipdate AS DATE) - 60 AS effective_date FROM lineitem
    UNION ALL SELECT 'PLACED', 'c' || o_custkey, 'o' || o_orderkey, CAST(o_orderdate AS DATE) FROM orders),
  n AS (SELECT cutoff, nodes.* FROM nodes JOIN cuts ON effective_date < cutoff),
  e AS (SELECT cutoff, edges.* FROM edges JOIN cuts ON effective_date < cutoff),
  k AS (SELECT e.* FROM e SEMI JOIN n AS a ON a.cutoff = e.cutoff AND a.id = e.src),
  kept AS (SELECT k.* FROM k SEMI JOIN n AS b ON b.cutoff = k.cutoff AND b.id = k.dst)"""


@query("c08_slice_graph", f"""WITH {_GRAPH}
SELECT CAST(c.cutoff AS VARCHAR) AS cutoff, (SELECT count(*) FROM n WHERE n.cutoff = c.cutoff) AS nodes, (SELECT count(*) FROM kept WHERE kept.cutoff = c.cutoff) AS edges,
  (SELECT count(*) FROM e WHERE e.cutoff = c.cutoff) - (SELECT count(*) FROM kept WHERE kept.cutoff = c.cutoff) AS dangling,
  CAST(greatest((SELECT max(effective_date) FROM n WHERE n.cutoff = c.cutoff), (SELECT max(effective_date) FROM kept WHERE kept.cutoff = c.cutoff)) AS VARCHAR) AS max_effective_date
FROM cuts c""")
def c08(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph_tables(spark, d)
    n, e = slices.asof(nodes, GRAPH_CUTS), slices.asof(edges, GRAPH_CUTS)
    out = slices.manifest(n, e, slices.visible_edges(nodes, edges, GRAPH_CUTS))
    return out.select(F.col("cutoff").cast("string").alias("cutoff"), "nodes", "edges", "dangling", F.col("max_effective_date").cast("string").alias("max_effective_date"))


@query("j07_drop_dangling", f"WITH {_GRAPH} SELECT CAST(cutoff AS VARCHAR) AS cutoff, type, count(*) AS edges FROM kept GROUP BY ALL")
def j07(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph_tables(spark, d)
    kept = slices.visible_edges(nodes, edges, GRAPH_CUTS)
    return kept.groupBy(F.col("cutoff").cast("string").alias("cutoff"), "type").agg(F.count("*").alias("edges"))


@query("j08_asof_slice", f"WITH {_EV}, {_CUTS} SELECT CAST(cutoff AS VARCHAR) AS cutoff, event_type, count(*) AS n, round(sum(weight), 4) AS weight FROM ev JOIN cuts ON date < cutoff GROUP BY ALL")
def j08(spark: SparkSession, d: str) -> DataFrame:
    return slices.asof(evidence(spark, d), CUTS).groupBy(F.col("cutoff").cast("string").alias("cutoff"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query("j06_referential_integrity", "WITH k AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT l_returnflag, count(*) AS dangling FROM lineitem ANTI JOIN k ON l_orderkey = o_orderkey GROUP BY ALL")
def j06(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").withColumn("id", F.monotonically_increasing_id()).select("id", F.col("l_orderkey").alias("src"), F.col("l_orderkey").alias("dst"), "l_returnflag")
    lost = slices.dangling(read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), lines)
    return lines.join(lost, "id", "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("dangling"))


@query("j09_masked_slice", """WITH hidden AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_size <= 10)
SELECT (SELECT count(*) FROM part WHERE p_size > 10) AS nodes, (SELECT count(*) FROM lineitem ANTI JOIN hidden ON 'p' || l_partkey = id) AS edges""")
def j09(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph_tables(spark, d)
    hidden = read(spark, d, "part").filter("p_size <= 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    n, e = slices.mask(nodes.filter("type = 'Part'"), edges.filter("type = 'CONTAINS'"), hidden)
    tagged = n.select(F.lit(1).alias("node"), F.lit(0).alias("edge")).union(e.select(F.lit(0), F.lit(1)))
    return tagged.agg(F.sum("node").alias("nodes"), F.sum("edge").alias("edges"))


@query("u04_slice_subset", f"WITH {_GRAPH} SELECT count(*) AS not_in_later FROM (SELECT id FROM n WHERE cutoff = DATE '1996-01-01' EXCEPT ALL SELECT id FROM n WHERE cutoff = DATE '1998-01-01')")
def u04(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = graph_tables(spark, d)
    return slices.not_in_later(slices.asof(nodes, GRAPH_CUTS), GRAPH_CUTS[0], GRAPH_CUTS[1]).agg(F.count("*").alias("not_in_later"))


@query("w01_revision_ledger", f"""WITH {_EV}, l AS (SELECT entity, record, row_number() OVER w AS seq, {_PRIOR} + sum(direction * weight * 0.85) OVER w AS posterior, direction * weight * 0.85 AS delta FROM ev
  WINDOW w AS (PARTITION BY entity ORDER BY date, record ROWS UNBOUNDED PRECEDING))
SELECT entity, record, seq, round(delta, 6) AS delta, round(posterior - delta, 6) AS prior, round(posterior, 6) AS posterior, round(1 / (1 + exp(-posterior)), 6) AS posterior_confidence FROM l""")
def w01(spark: SparkSession, d: str) -> DataFrame:
    out = ledger.revise(evidence(spark, d), ["entity"])
    return out.select("entity", "record", F.col("seq").cast("long").alias("seq"), *[F.round(c, 6).alias(c) for c in ("delta", "prior", "posterior", "posterior_confidence")])


_CLAIM = "CAST(cutoff AS VARCHAR) AS cutoff, entity, log_odds, confidence, evidence, round(max_support, 6) AS max_support, round(max_composition, 6) AS max_composition, publications, CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date, coalesce(supporting, '') AS supporting, coalesce(contradicting, '') AS contradicting"


@query("a08_claim_rollup", f"WITH {_EV}, {_CUTS}, {_ROLL} SELECT {_CLAIM} FROM roll")
def a08(spark: SparkSession, d: str) -> DataFrame:
    text_of = {c: F.col(c).cast("string") for c in ("cutoff", "first_date", "last_date")}
    lists = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("supporting", "contradicting")}
    return rolled(spark, d).withColumns(text_of | lists | {c: F.round(c, 6) for c in ("max_support", "max_composition")})


@query("c11_forecast", f"{_BASE} SELECT CAST(cutoff AS VARCHAR) AS cutoff, entity, confidence, cost_score, route, rank, cost_rank FROM ranked")
def c11(spark: SparkSession, d: str) -> DataFrame:
    out = ranked(spark, d).withColumn("cutoff", F.col("cutoff").cast("string"))
    return longs(out.select("cutoff", "entity", "confidence", "cost_score", "route", "rank", "cost_rank"), "rank", "cost_rank")


@query("p22_claim_gate", f"{_BASE} SELECT CAST(cutoff AS VARCHAR) AS cutoff, outcome, count(*) AS claims, round(avg(confidence), 5) AS mean_confidence FROM decided GROUP BY ALL")
def p22(spark: SparkSession, d: str) -> DataFrame:
    return decided(spark, d).groupBy(F.col("cutoff").cast("string").alias("cutoff"), "outcome").agg(F.count("*").alias("claims"), F.round(F.avg("confidence"), 5).alias("mean_confidence"))


@query("p23_refusal_reason", f"""{_BASE} SELECT CAST(cutoff AS VARCHAR) AS cutoff, entity, CASE WHEN confidence < 0.25 THEN 'confidence ' || printf('%.3f', confidence) || ' is below 0.25'
  ELSE 'strongest support ' || printf('%.3f', coalesce(max_support, 0)) || ' is below 0.30 and no other route holds' END AS reason FROM decided WHERE outcome = 'refused'""")
def p23(spark: SparkSession, d: str) -> DataFrame:
    return decided(spark, d).filter("outcome = 'refused'").select(F.col("cutoff").cast("string").alias("cutoff"), "entity", "reason")


@query("c12_flat_baseline", f"""WITH {_EV}, {_CUTS}, c AS (SELECT cutoff, entity, count(*) AS publications, count(*) FILTER (WHERE tier) AS tier_publications FROM ev JOIN cuts ON date < cutoff GROUP BY ALL)
SELECT CAST(cutoff AS VARCHAR) AS cutoff, entity, publications, tier_publications, round(tier_publications / greatest(max(tier_publications) OVER (PARTITION BY cutoff), 1), 6) AS confidence FROM c""")
def c12(spark: SparkSession, d: str) -> DataFrame:
    return forecast.flat_baseline(slices.asof(evidence(spark, d), CUTS), ["cutoff"], "entity").withColumn("cutoff", F.col("cutoff").cast("string"))


@query("w02_literature_increments", f"""WITH {_EV}, k AS (SELECT entity, record, tier, row_number() OVER (PARTITION BY entity ORDER BY date, record) AS k FROM ev)
SELECT entity, record, k, round((ln(1 + k) - ln(k)) * CASE WHEN tier THEN 1.0 ELSE 0.25 END / 0.85, 6) AS weight FROM k""")
def w02(spark: SparkSession, d: str) -> DataFrame:
    out = ledger.literature_increments(evidence(spark, d), ["entity"])
    return out.select("entity", "record", F.col("k").cast("long").alias("k"), F.round("weight", 6).alias("weight"))


@query("w03_essentiality_increments", """WITH r AS (SELECT l_partkey AS entity, CAST(l_shipdate AS DATE) AS date, l_orderkey * 10 + l_linenumber AS record, l_quantity > 10 AS hit, avg(CASE WHEN l_quantity > 10 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY l_partkey) AS fraction FROM lineitem),
  h AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date, record) AS k, count(*) OVER (PARTITION BY entity) AS n FROM r WHERE hit AND fraction >= 0.70)
SELECT entity, count(*) AS hits, round(sum(1.2 * fraction * (ln(1 + k) - ln(k)) / ln(1 + n) / 0.85), 6) AS weight FROM h GROUP BY entity""")
def w03(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_shipdate").cast("date").alias("date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record"), (F.col("l_quantity") > 10).alias("hit"))
    return ledger.essentiality_increments(rows, ["entity"]).groupBy("entity").agg(F.count("*").alias("hits"), F.round(F.sum("weight"), 6).alias("weight"))


# lineitem as measurements of parts; discount stands for a p-value
SYSTEMS, ASSAYS, PERTURBATIONS = {"O": 1.0, "F": 0.3471313}, {"A": 1.0, "N": 0.6131313, "R": 0.2573373}, {1: 1.0, 2: 0.7091717}
P_MOST = 0.005


def measurements(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    line, part = read(spark, d, "lineitem"), read(spark, d, "part").select("p_partkey", "p_type")
    out = line.join(part, c("l_partkey") == c("p_partkey"), "left")
    return out.select(c("l_partkey").alias("entity"), c("l_orderkey").alias("pmid"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("record"), c("l_shipdate").cast("date").alias("date"), (c("l_discount") + 0.001).alias("p"), c("l_returnflag").alias("assay"), c("l_linestatus").alias("system"), F.least(c("l_linenumber"), F.lit(2)).alias("perturbation"), F.when(c("p_type").isin("ECONOMY", "PROMO"), "direct_protein").when(c("p_type") == "STANDARD", "transcript").alias("directness"), (c("l_tax") > 0.04).alias("author_reported"), c("p_type").alias("phenotype"), (c("l_quantity") > 25).alias("hit"))


_M = """m AS (SELECT l_partkey AS entity, l_orderkey AS pmid, l_orderkey * 10 + l_linenumber AS record, CAST(l_shipdate AS DATE) AS date, l_discount + 0.001 AS p, l_returnflag AS assay, l_linestatus AS system,
  least(l_linenumber, 2) AS perturbation, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 1.0 WHEN p_type = 'STANDARD' THEN 0.65 ELSE 0.35 END AS direct, l_tax > 0.04 AS author_reported, p_type AS phenotype, l_quantity > 25 AS hit
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
  s AS (SELECT entity, count(DISTINCT pmid) AS replicates, bool_or(p < 0.005) AS supported FROM m GROUP BY entity),
  w AS (SELECT m.*, replicates, supported, round(least(greatest(
    CASE system WHEN 'O' THEN 1.0 WHEN 'F' THEN 0.3471313 ELSE 0.1 END * CASE perturbation WHEN 1 THEN 1.0 WHEN 2 THEN 0.7091717 ELSE 0.35 END * direct
    * CASE WHEN replicates <= 1 THEN 1.0 WHEN replicates = 2 THEN 1.35 WHEN replicates = 3 THEN 1.55 ELSE 1.7 END * CASE WHEN supported THEN 1.3 ELSE 1.0 END
    * CASE assay WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.6131313 WHEN 'R' THEN 0.2573373 ELSE 0.5 END * CASE WHEN author_reported THEN 0.55 ELSE 1.0 END, 0.01), 2.0), 6) AS weight FROM m JOIN s USING (entity))"""


def weighed(spark: SparkSession, d: str) -> DataFrame:
    return weigh.weigh(measurements(spark, d), ["entity"], {"system": SYSTEMS, "assay": ASSAYS, "perturbation": PERTURBATIONS}, p_most=P_MOST)


@query("a01_replication_counts", "SELECT l_partkey AS entity, count(DISTINCT l_orderkey) AS replicates FROM lineitem GROUP BY ALL")
def a01(spark: SparkSession, d: str) -> DataFrame:
    return weigh.replication_counts(measurements(spark, d), ["entity"], "pmid")


@query("a02_genetic_support", f"WITH {_M} SELECT entity FROM s WHERE supported")
def a02(spark: SparkSession, d: str) -> DataFrame:
    return weigh.genetic_support(measurements(spark, d), ["entity"], "p", P_MOST)


@query("j12_measurement_weight", f"WITH {_M} SELECT record, entity, replicates, supported, weight FROM w")
def j12(spark: SparkSession, d: str) -> DataFrame:
    return weighed(spark, d).select("record", "entity", "replicates", "supported", "weight")


def ids_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("record_ids", F.array_join(F.col("record_ids").cast("array<string>"), ","))


@query("a03_genetic_rules", f"""WITH {_M} SELECT entity, round(min(p), 6) AS best_p, arg_min(phenotype, (p, record)) AS phenotype, round(sum(weight), 6) AS weight_total, max(weight) AS best_weight,
  arg_max(record, (weight, record)) AS best_record, bool_and(author_reported) AS all_author_reported, count(*) AS records, string_agg(record, ',' ORDER BY record) AS record_ids FROM w WHERE p < 0.005 GROUP BY entity""")
def a03(spark: SparkSession, d: str) -> DataFrame:
    return ids_as_text(derive.genetic_rules(weighed(spark, d), ["entity"], P_MOST).withColumn("best_p", F.round("best_p", 6))).drop("best_date")


@query("a04_essentiality_rules", f"WITH {_M} SELECT entity, count(*) FILTER (WHERE hit) AS hits, count(*) AS n, round(sum(weight), 6) AS weight_total, round(count(*) FILTER (WHERE hit) / count(*), 6) AS fraction, count(*) FILTER (WHERE hit) / count(*) >= 0.7 AS pan_essential, string_agg(record, ',' ORDER BY record) AS record_ids FROM w GROUP BY entity HAVING count(*) >= 3")
def a04(spark: SparkSession, d: str) -> DataFrame:
    return ids_as_text(derive.essentiality_rules(weighed(spark, d), ["entity"]))


@query("a05_functional_rules", f"""WITH {_M}, f AS (SELECT * FROM w WHERE assay <> 'A') SELECT entity, count(*) AS records, count(DISTINCT system) AS systems, round(sum(weight), 6) AS weight_total, max(weight) AS best_weight,
  (list(record ORDER BY weight DESC, date, record))[1] AS best_record, string_agg(record, ',' ORDER BY record) AS record_ids FROM f GROUP BY entity""")
def a05(spark: SparkSession, d: str) -> DataFrame:
    return ids_as_text(derive.functional_rules(weighed(spark, d).filter("assay <> 'A'"), ["entity"])).drop("best_date")


@query("w08_best_measurement", f"""WITH {_M}, g AS (SELECT entity, max(weight) AS best_weight, arg_max(record, (weight, record)) AS best_record, 0 AS kind FROM w WHERE p < 0.005 GROUP BY entity),
  f AS (SELECT entity, max(weight) AS best_weight, (list(record ORDER BY weight DESC, date, record))[1] AS best_record, 1 AS kind FROM w WHERE assay <> 'A' GROUP BY entity)
SELECT entity, best_weight, best_record, kind FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY best_weight DESC, kind) AS k FROM (SELECT * FROM g UNION ALL SELECT * FROM f)) WHERE k = 1""")
def w08(spark: SparkSession, d: str) -> DataFrame:
    w = weighed(spark, d)
    return derive.best_measurement(derive.genetic_rules(w, ["entity"], P_MOST), derive.functional_rules(w.filter("assay <> 'A'"), ["entity"]), ["entity"]).drop("best_date")


@query("j14_composition", f"""WITH {_M}, best AS (SELECT entity, max(weight) AS best_weight FROM w WHERE assay <> 'A' GROUP BY entity), own AS (SELECT DISTINCT entity FROM m WHERE phenotype = 'PROMO'),
  x AS (SELECT a.p_partkey AS entity, b.p_partkey AS partner, (35 * CAST(round(best_weight * 1000000) AS BIGINT) + 50) // 100 / 1000000.0 AS transferred, row_number() OVER (PARTITION BY a.p_partkey ORDER BY (35 * CAST(round(best_weight * 1000000) AS BIGINT) + 50) // 100 / 1000000.0 DESC, b.p_partkey) AS k
  FROM part a JOIN part b ON a.p_partkey // 4 = b.p_partkey // 4 AND a.p_partkey <> b.p_partkey JOIN best ON best.entity = b.p_partkey ANTI JOIN own ON own.entity = a.p_partkey)
SELECT entity, partner, transferred FROM x WHERE k = 1""")
def j14(spark: SparkSession, d: str) -> DataFrame:
    w = weighed(spark, d)
    best = w.filter("assay <> 'A'").groupBy("entity").agg(F.max("weight").alias("best_weight"), F.min("record").alias("best_record"), F.min("date").alias("best_date"))
    return derive.composition(part_pairs(spark, d), best, w.filter("phenotype = 'PROMO'").select("entity").distinct()).select("entity", "partner", "transferred")


def part_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of parts in groups of four, whatever the size of the table: src, dst, date, id."""
    members = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 4).cast("string").alias("group"), F.lit("1990-01-01").cast("date").alias("date"))
    return resolve.group_pairs(members).withColumn("id", F.col("dst"))


@query("a06_literature_rules", f"WITH {_EV} SELECT entity, count(*) AS publications, count(*) FILTER (WHERE tier) AS tier_publications, CAST(min(date) AS VARCHAR) AS earliest, round(0.20 * count(*) FILTER (WHERE tier) + 0.05 * count(*) FILTER (WHERE NOT tier), 6) AS weight FROM ev GROUP BY entity")
def a06(spark: SparkSession, d: str) -> DataFrame:
    return derive.literature_rules(evidence(spark, d), ["entity"]).withColumn("earliest", F.col("earliest").cast("string"))


@query("w06_earliest_k", f"""WITH {_EV}, c AS (SELECT *, max(CAST(tier AS INT)) OVER (PARTITION BY entity) AS has FROM ev), k AS (SELECT entity, record, row_number() OVER (PARTITION BY entity ORDER BY date, record) AS k FROM c WHERE has = 0 OR tier)
SELECT * FROM k WHERE k <= 5""")
def w06(spark: SparkSession, d: str) -> DataFrame:
    return longs(derive.literature_evidence(evidence(spark, d), ["entity"], 5).select("entity", "record", "k"), "k")


FAMILIES = {"ECONOMY": "Protein kinases", "PROMO": "Zinc fingers C2H2", "STANDARD": "BAF complex subunits", "MEDIUM": "Histone deacetylases", "LARGE": "Homeoboxes", "SMALL": "Ankyrin repeats"}


@query("p18_infer_modality", """SELECT p_partkey AS entity, CASE WHEN p_size > 45 THEN 'NOT_THERAPEUTIC' WHEN p_size < 3 THEN 'EX_VIVO_SINGLE_EDIT' WHEN p_type IN ('ECONOMY', 'MEDIUM') THEN 'SMALL_MOLECULE' WHEN p_brand = 'Brand#7' THEN 'EX_VIVO_SINGLE_EDIT' WHEN p_type = 'STANDARD' THEN 'EX_VIVO_MULTI_EDIT' ELSE 'EX_VIVO_SINGLE_EDIT' END AS route,
  CASE WHEN p_size > 45 THEN 0.0 WHEN p_size < 3 THEN 1.0 WHEN p_type IN ('ECONOMY', 'MEDIUM') THEN 10.0 WHEN p_brand = 'Brand#7' THEN 1.0 WHEN p_type = 'STANDARD' THEN 0.4 ELSE 1.0 END AS weight FROM part""")
def p18(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    entities = p.select(F.col("p_partkey").alias("entity"), rules.lookup(FAMILIES, F.col("p_type")).alias("family"), F.when(F.col("p_size") < 3, "RNA, long non-coding").otherwise("gene with protein product").alias("locus"), F.lit(True).alias("raises"), (F.col("p_brand") == "Brand#7").alias("cis_element"))
    return derive.modality_rules(entities, p.filter("p_size > 45").select(F.col("p_partkey").alias("entity"), F.lit(True).alias("pan_essential"))).select("entity", "route", "weight")


def nation_entities(spark: SparkSession, d: str) -> DataFrame:
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("symbol"), F.concat(F.lit("E"), "n_nationkey").alias("entrez"), F.lit(None).cast("string").alias("ensembl"), F.array(F.col("r_name"), F.concat(F.lit("alt_"), "n_nationkey")).alias("aliases"), F.array(F.concat(F.lit("old_"), "n_nationkey")).alias("previous"))


def asked_names(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").join(read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 6
    name = F.when(k == 0, F.lower("n_name")).when(k == 1, F.concat(F.lit(" ALT_"), "n_nationkey")).when(k == 2, F.col("r_name")).when(k == 3, F.concat(F.lit("e"), "n_nationkey")).when(k == 4, F.concat(F.lit("Old_"), "n_nationkey")).otherwise("")
    return c.select("c_custkey", name.alias("name"))


_NAMES = "names AS (SELECT c_custkey, c_custkey % 6 AS k, n_nationkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), peers AS (SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)"


@query("j01_resolve_symbols", f"WITH {_NAMES} SELECT c_custkey, CASE WHEN k = 5 OR (k = 2 AND n > 1) THEN NULL ELSE n_nationkey END AS id, CASE WHEN k = 5 THEN 'empty' WHEN k = 2 AND n > 1 THEN 'ambiguous ' || n END AS reason FROM names JOIN peers USING (r_name)")
def j01(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(asked_names(spark, d), nation_entities(spark, d)).select("c_custkey", "id", "reason")


@query("j02_resolve_in_graph", f"WITH {_NAMES} SELECT c_custkey, CASE WHEN k IN (0, 1) OR (k = 2 AND n = 1) THEN n_nationkey END AS id FROM names JOIN peers USING (r_name)")
def j02(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_in_graph(asked_names(spark, d), nation_entities(spark, d)).select("c_custkey", "id")


# parts as entities: the name is the symbol; one alias of its own, one that ten parts share
def part_entities(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    names = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    return read(spark, d, "part").select(k.alias("id"), names("P", k).alias("symbol"), names("E", k).alias("entrez"), F.lit(None).cast("string").alias("ensembl"), F.array(names("alias_", k), names("shared_", F.floor(k / 10))).alias("aliases"), F.array(names("old_", k)).alias("previous"), F.array(names("P", k + 1)).alias("informal"))


@query("j23_alias_probes", "SELECT count(*) * 4 AS probes, count(*) + count(*) FILTER (WHERE n = 1) AS resolved FROM (SELECT count(*) OVER (PARTITION BY p_partkey // 10) AS n FROM part)")
def j23(spark: SparkSession, d: str) -> DataFrame:
    entities = part_entities(spark, d)
    return resolve.alias_probe_score(traps.alias_probes(entities), entities)


@query("j15_complex_pairs", "SELECT a.s_suppkey AS src, b.s_suppkey AS dst, CAST(a.s_suppkey // 5 AS VARCHAR) AS \"group\" FROM supplier a JOIN supplier b ON a.s_suppkey // 5 = b.s_suppkey // 5 AND a.s_suppkey <> b.s_suppkey")
def j15(spark: SparkSession, d: str) -> DataFrame:
    members = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.floor(F.col("s_suppkey") / 5).cast("string").alias("group"), F.lit("2000-01-01").cast("date").alias("date"))
    return resolve.group_pairs(members).select("src", "dst", F.col("groups")[0].alias("group"))


# grading
_HITS = "hits AS (SELECT cutoff, entity FROM truth JOIN cuts ON established >= cutoff)"


def truth_by_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return grade.ground_truth(established(spark, d), CUTS)


@query("a18_ground_truth", f"WITH {_EV}, {_CUTS}, {_TRUTH}, {_HITS} SELECT CAST(cutoff AS VARCHAR) AS cutoff, count(*) AS entities FROM hits GROUP BY cutoff")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return truth_by_cutoff(spark, d).groupBy(F.col("cutoff").cast("string").alias("cutoff")).agg(F.count("*").alias("entities"))


@query("t09_ranking_metrics", f"""{_BASE}, {_HITS}, r AS (SELECT ranked.*, hits.entity IS NOT NULL AS hit FROM ranked LEFT JOIN hits USING (cutoff, entity))
SELECT CAST(cutoff AS VARCHAR) AS cutoff, count(*) FILTER (WHERE hit AND rank <= 5) / 5 AS p_at_5, count(*) FILTER (WHERE hit AND rank <= 10) / 10 AS p_at_10, round(coalesce(1 / min(CASE WHEN hit THEN rank END), 0), 6) AS reciprocal_rank, count(*) FILTER (WHERE hit) AS hits, count(*) AS ranked FROM r GROUP BY cutoff""")
def t09(spark: SparkSession, d: str) -> DataFrame:
    out = grade.ranking_metrics(ranked(spark, d), truth_by_cutoff(spark, d), ["cutoff"])
    return out.withColumns({"cutoff": F.col("cutoff").cast("string"), "reciprocal_rank": F.round("reciprocal_rank", 6)})


def scored(spark: SparkSession, d: str) -> DataFrame:
    t = truth_by_cutoff(spark, d).select("cutoff", "entity", F.lit(True).alias("hit"))
    return decided(spark, d).filter("outcome <> 'established'").join(t, ["cutoff", "entity"], "left").fillna(False, ["hit"])


_BINS = f"""{_BASE}, {_HITS}, sc AS (SELECT cutoff, confidence, hits.entity IS NOT NULL AS hit FROM decided LEFT JOIN hits USING (cutoff, entity) WHERE outcome <> 'established'),
  b AS (SELECT cutoff, least(CAST(floor(confidence * 5) AS INT), 4) AS bin, count(*) AS n, avg(confidence) AS mean_confidence, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS observed FROM sc GROUP BY 1, 2),
  bins AS (SELECT c.cutoff, g.bin, coalesce(n, 0) AS n, coalesce(mean_confidence, 0) AS mean_confidence, coalesce(observed, 0) AS observed FROM (SELECT DISTINCT cutoff FROM sc) c CROSS JOIN (SELECT unnest(range(5)) AS bin) g LEFT JOIN b ON b.cutoff = c.cutoff AND b.bin = g.bin)"""


@query("a19_calibration_bins", f"{_BINS} SELECT CAST(cutoff AS VARCHAR) AS cutoff, bin, n, round(mean_confidence, 5) AS mean_confidence, round(observed, 5) AS observed FROM bins")
def a19(spark: SparkSession, d: str) -> DataFrame:
    out = grade.calibration_bins(scored(spark, d), ["cutoff"])
    return longs(out.withColumns({"cutoff": F.col("cutoff").cast("string"), "mean_confidence": F.round("mean_confidence", 5), "observed": F.round("observed", 5)}), "bin")


@query("a19_calibration_error", f"{_BINS} SELECT CAST(cutoff AS VARCHAR) AS cutoff, round(sum(n * abs(mean_confidence - observed)) / sum(n), 5) AS ece FROM bins GROUP BY cutoff")
def a19_error(spark: SparkSession, d: str) -> DataFrame:
    return grade.calibration_error(grade.calibration_bins(scored(spark, d), ["cutoff"]), ["cutoff"]).withColumns({"cutoff": F.col("cutoff").cast("string"), "ece": F.round("ece", 5)})


_TRAPS = f"""{_BASE}, t AS (SELECT cutoff, u AS entity, CASE u % 3 WHEN 0 THEN 'reject' WHEN 1 THEN 'refuse' ELSE 'accept' END AS answer, CASE u % 6 WHEN 0 THEN 'association' WHEN 3 THEN 'essential' WHEN 1 THEN 'postdates_cutoff' WHEN 4 THEN 'postdates_cutoff' ELSE 'control' END AS kind FROM cuts CROSS JOIN (SELECT DISTINCT user_id AS u FROM events)),
  sizes AS (SELECT cutoff, count(*) AS size FROM ranked GROUP BY cutoff),
  o AS (SELECT t.*, CASE answer WHEN 'reject' THEN NOT coalesce(ranked.rank <= 10 OR ranked.cost_rank <= 10, false) WHEN 'refuse' THEN coalesce(said = 'refused', true) ELSE coalesce(said = 'forecast', false) END AS passed, answer = 'reject' AND coalesce(size, 0) = 0 AS vacuous
  FROM t LEFT JOIN (SELECT cutoff, entity, outcome AS said FROM decided) f USING (cutoff, entity) LEFT JOIN ranked USING (cutoff, entity) LEFT JOIN sizes USING (cutoff))"""


def trap_rows(spark: SparkSession, d: str) -> DataFrame:
    users = read(spark, d, "events").select(F.col("user_id").alias("entity")).distinct()
    answer = F.element_at(F.array(F.lit("reject"), F.lit("refuse"), F.lit("accept")), (F.col("entity") % 3 + 1).cast("int"))
    t = users.withColumn("cutoff", F.explode(F.array(*[F.lit(c).cast("date") for c in CUTS]))).withColumn("answer", answer)
    kinds = [F.lit(k) for k in ("association", "postdates_cutoff", "control", "essential", "postdates_cutoff", "control")]
    t = t.withColumn("kind", F.element_at(F.array(*kinds), (F.col("entity") % 6 + 1).cast("int")))
    ranks = ranked(spark, d).select("cutoff", "entity", "rank", "cost_rank")
    return grade.trap_outcomes(t, decided(spark, d).join(ranks, ["cutoff", "entity"], "left"), ["cutoff"])


@query("j18_trap_outcomes", f"{_TRAPS} SELECT CAST(cutoff AS VARCHAR) AS cutoff, entity, answer, passed, vacuous FROM o")
def j18(spark: SparkSession, d: str) -> DataFrame:
    return trap_rows(spark, d).drop("kind").withColumn("cutoff", F.col("cutoff").cast("string"))


@query("a20_trap_rollup", f"""{_TRAPS} SELECT CAST(cutoff AS VARCHAR) AS cutoff, count(*) AS traps, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE passed AND vacuous) AS vacuous, count(*) FILTER (WHERE passed AND NOT vacuous) AS meaningful,
  count(*) FILTER (WHERE kind <> 'postdates_cutoff') AS judgement_total, count(*) FILTER (WHERE kind <> 'postdates_cutoff' AND passed AND NOT vacuous) AS judgement, count(*) FILTER (WHERE kind = 'postdates_cutoff') AS contamination_total, count(*) FILTER (WHERE kind = 'postdates_cutoff' AND passed) AS contamination FROM o GROUP BY cutoff""")
def a20(spark: SparkSession, d: str) -> DataFrame:
    return grade.trap_rollup(trap_rows(spark, d), ["cutoff"]).withColumn("cutoff", F.col("cutoff").cast("string"))


@query("a22_cost_lens", f"{_BASE} SELECT CAST(cutoff AS VARCHAR) AS cutoff, count(*) FILTER (WHERE rank <> cost_rank) AS moved, max(CASE WHEN rank = 1 THEN route END) AS first_route, max(CASE WHEN cost_rank = 1 THEN route END) AS first_cost_route, min(CASE WHEN route = 'SMALL_MOLECULE' THEN cost_rank END) AS small_molecule_rank FROM ranked GROUP BY cutoff")
def a22(spark: SparkSession, d: str) -> DataFrame:
    return longs(grade.cost_lens(ranked(spark, d), ["cutoff"]).withColumn("cutoff", F.col("cutoff").cast("string")), "small_molecule_rank")


@query("a21_refusal_accuracy", f"""{_BASE} SELECT count(*) AS should_refuse, count(*) FILTER (WHERE r) AS refused, count(*) FILTER (WHERE t) AS turned_out_true
FROM (SELECT u, u IN (SELECT entity FROM decided WHERE outcome = 'refused' AND cutoff = DATE '2024-01-10') AS r, u IN (SELECT entity FROM truth WHERE established >= DATE '2024-01-10') AS t FROM (SELECT DISTINCT user_id AS u FROM events))""")
def a21(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "events").select(F.col("user_id").alias("entity"))
    first = F.col("cutoff") == F.lit(CUTS[0]).cast("date")
    return grade.refusal_accuracy(asked, decided(spark, d).filter(first), truth_by_cutoff(spark, d).filter(first))


@query("c16_bootstrap_intervals")
def c16(spark: SparkSession, d: str) -> DataFrame:
    t = truth_by_cutoff(spark, d).select("cutoff", "entity", F.lit(True).alias("hit"))
    asked = merge.asked_units(decided(spark, d).filter("outcome <> 'established'").select("cutoff", "entity"), t.select("cutoff", "entity"))
    units = asked.join(ranked(spark, d).select("cutoff", "entity", "rank"), ["cutoff", "entity"], "left").join(t, ["cutoff", "entity"], "left").fillna(False, ["hit"]).withColumnRenamed("entity", "unit")
    return grade.bootstrap_intervals(units, ["cutoff"]).withColumn("cutoff", F.col("cutoff").cast("string"))


@query("w14_gene_history", f"""{_BASE}, {_HITS}, v AS (SELECT cutoff, entity, CASE WHEN outcome = 'established' THEN 'known' WHEN outcome = 'forecast' AND h.entity IS NOT NULL THEN 'hit' WHEN outcome = 'forecast' THEN 'forecast' WHEN h.entity IS NOT NULL THEN 'missed' WHEN outcome = 'refused' THEN 'refused' ELSE 'none' END AS verdict FROM decided LEFT JOIN (SELECT DISTINCT cutoff, entity FROM hits) h USING (cutoff, entity)),
  l AS (SELECT *, lag(verdict) OVER (PARTITION BY entity ORDER BY cutoff) AS before FROM v)
SELECT CAST(cutoff AS VARCHAR) AS cutoff, entity, verdict, before, coalesce(before <> verdict, false) AS changed FROM l""")
def w14(spark: SparkSession, d: str) -> DataFrame:
    t = truth_by_cutoff(spark, d).select("cutoff", "entity", F.lit(True).alias("true"))
    rows = decided(spark, d).join(t, ["cutoff", "entity"], "left").fillna(False, ["true"])
    is_ = lambda o: F.col("outcome") == o
    verdicts = rows.select("cutoff", "entity", rules.verdict(is_("established"), is_("forecast"), is_("refused"), F.col("true")).alias("verdict"))
    return forecast.history(verdicts).withColumn("cutoff", F.col("cutoff").cast("string"))


# citations: turns of conversations cite documents; the context is the same language, the slice the lower half of the ids
_CITE = """cited AS (SELECT conv_id * 10 + turn AS claim, (conv_id * 37 + turn * 11) % 1300 AS record_id FROM conversations),
  st AS (SELECT claim, record_id, CASE WHEN record_id % 5 = claim % 5 AND doc_id IS NOT NULL THEN 'in_context' WHEN record_id < 500 AND doc_id IS NOT NULL THEN 'out_of_context' WHEN doc_id IS NOT NULL THEN 'post_cutoff' ELSE 'fabricated' END AS status FROM cited LEFT JOIN documents ON doc_id = record_id)"""


def citations(spark: SparkSession, d: str) -> DataFrame:
    cited = read(spark, d, "conversations").select((F.col("conv_id") * 10 + F.col("turn")).alias("claim"), ((F.col("conv_id") * 37 + F.col("turn") * 11) % 1300).alias("record_id"))
    store = read(spark, d, "documents").select(F.col("doc_id").alias("record_id"))
    context = cited.filter("record_id % 5 = claim % 5").join(store, "record_id", "left_semi")
    return grade.classify_citations(cited, context, store.filter("record_id < 500"), store)


@query("j20_classify_citations", f"WITH {_CITE} SELECT status, count(*) AS n FROM st GROUP BY status")
def j20(spark: SparkSession, d: str) -> DataFrame:
    return citations(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("a23_grounding_rates", f"WITH {_CITE} SELECT claim, bool_or(status = 'in_context' AND record_id % 2 = 0) AS grounded, count(*) AS citations, coalesce(array_to_string(list_sort(list(DISTINCT record_id) FILTER (WHERE status = 'post_cutoff')), ','), '') AS post_cutoff, coalesce(array_to_string(list_sort(list(DISTINCT record_id) FILTER (WHERE status = 'fabricated')), ','), '') AS fabricated FROM st GROUP BY claim")
def a23(spark: SparkSession, d: str) -> DataFrame:
    out = grade.grounding(citations(spark, d).withColumn("names", F.col("record_id") % 2 == 0))
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("post_cutoff", "fabricated")})


@query("j19_trace_records", "SELECT (SELECT count(DISTINCT l_partkey) FROM lineitem) AS objects, count(*) AS ids, count(*) FILTER (WHERE o_orderkey IS NULL) AS untraceable, count(*) FILTER (WHERE o_orderkey IS NOT NULL AND o_orderpriority = '5-LOW') AS unlicensed FROM (SELECT DISTINCT l_partkey, l_orderkey + 7 AS r FROM lineitem) LEFT JOIN orders ON r = o_orderkey")
def j19(spark: SparkSession, d: str) -> DataFrame:
    named = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("object")).agg(F.collect_set(F.col("l_orderkey") + 7).alias("record_ids"))
    nodes = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") != "5-LOW", "open").alias("license"))
    return grade.trace_records(named, nodes)


# graph walks over a small part of the chain: nation -> region, supplier -> nation
def walk_edges(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), F.lit("IN").alias("type"))
    n = read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("PART_OF").alias("type"))
    ring = read(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("src"), F.concat(F.lit("r"), (F.col("r_regionkey") + 1) % 5).alias("dst"), F.lit("NEXT").alias("type"))
    return merge.union_all(s, n, ring)


_WALK = "e AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, 'IN' AS type FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'PART_OF' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || ((r_regionkey + 1) % 5), 'NEXT' FROM region)"


@query("g01_acts_through_chain", f"""WITH RECURSIVE {_WALK}, p(start, src, dst, path, depth) AS (SELECT src, src, dst, [src, dst], 1 FROM e WHERE src LIKE 's%'
  UNION ALL SELECT p.start, p.dst, e.dst, list_append(p.path, e.dst), p.depth + 1 FROM p JOIN e ON p.dst = e.src WHERE p.depth < 4 AND NOT list_contains(p.path, e.dst)) SELECT start, src, dst, depth FROM p""")
def g01(spark: SparkSession, d: str) -> DataFrame:
    starts = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("start"))
    return graph.chains(walk_edges(spark, d), starts)


@query("g02_provenance_chain", f"""WITH RECURSIVE {_WALK}, m AS (SELECT dst AS f, src AS t FROM e UNION SELECT src, dst FROM e WHERE type = 'NEXT'),
  p(start, id, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION SELECT p.start, m.t, p.depth + 1 FROM p JOIN m ON p.id = m.f WHERE p.depth < 4) SELECT start, id, depth FROM p""")
def g02(spark: SparkSession, d: str) -> DataFrame:
    starts = read(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("start"))
    return graph.provenance(walk_edges(spark, d), starts, ("NEXT",))


@query("t02_latest_measurements", "SELECT l_partkey AS entity, record, place, total FROM (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS record, row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(l_shipdate AS DATE) DESC, l_orderkey * 10 + l_linenumber) AS place, count(*) OVER (PARTITION BY l_partkey) AS total FROM lineitem) WHERE place <= 20")
def t02(spark: SparkSession, d: str) -> DataFrame:
    return longs(graph.latest(measurements(spark, d), "entity", "date", "record").select("entity", "record", "place", "total"), "place")


@query("t04_complex_partners", "SELECT src AS entity, dst AS partner, place, total FROM (SELECT a.s_suppkey AS src, b.s_suppkey AS dst, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY b.s_suppkey) AS place, count(*) OVER (PARTITION BY a.s_suppkey) AS total FROM supplier a JOIN supplier b ON a.s_suppkey // 5 = b.s_suppkey // 5 AND a.s_suppkey <> b.s_suppkey) WHERE place <= 20")
def t04(spark: SparkSession, d: str) -> DataFrame:
    return longs(graph.partners(j15(spark, d)).select("entity", "partner", "place", "total"), "place")


@query("t05_publication_count", "SELECT c_custkey AS entity, count(o_orderkey) AS publications FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def t05(spark: SparkSession, d: str) -> DataFrame:
    customers = read(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("symbol"))
    return graph.by_publication_count(customers, read(spark, d, "orders").select(F.col("o_custkey").alias("entity"))).select("entity", "publications")


@query("a26_measurements_by_assay", "SELECT l_partkey AS entity, l_returnflag AS assay, count(*) AS n FROM lineitem GROUP BY ALL")
def a26(spark: SparkSession, d: str) -> DataFrame:
    return graph.measurements_by_assay(measurements(spark, d))


# retrieval over document texts; the queries are the first words of the benchmark's items
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


_PHRASES = rf"""words AS (SELECT item_id, {_TOK} AS w FROM benchmark), asked AS (SELECT item_id * 1000000 + i AS query, w[i : i + 1] AS p FROM (SELECT item_id, w, unnest(range(1, len(w) + 1, 2)) AS i FROM words)),
  t AS (SELECT doc_id AS id, {_TOK} AS w FROM documents), st AS (SELECT count(*) AS docs, avg(len(w)) AS mean_length FROM t),
  x AS (SELECT id, len(w) AS length, unnest(w) AS a, unnest(list_append(w[2:], NULL)) AS b FROM t),
  tf AS (SELECT query, id, length, count(*) AS tf FROM x JOIN asked ON p[1] = a AND (len(p) = 1 OR p[2] = b) GROUP BY ALL), df AS (SELECT query, count(*) AS df FROM tf GROUP BY query),
  s AS (SELECT query, id, round(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)), 6) AS score FROM tf JOIN df USING (query) CROSS JOIN st),
  lexical AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s)"""
_NEAREST = """v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
  c AS (SELECT q.id AS query, v.id, round(list_dot_product(q.v, v.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(v.v, v.v))), 6) AS score FROM v CROSS JOIN (SELECT * FROM v WHERE id % 50 = 0) q),
  dense AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM c)"""


@query("t06_bm25_top_k", f"WITH {_PHRASES} SELECT query, id, score, rank FROM lexical WHERE rank <= 50")
def t06(spark: SparkSession, d: str) -> DataFrame:
    titles = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))
    return longs(retrieval.bm25(titles, phrase_queries(spark, d)), "rank")


def phrase_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item as phrases of two words, side by side over its whole text."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    places = F.filter(F.transform(words, lambda w, i: F.struct((i + 1).alias("i"), F.array_join(F.slice(words, i + 1, F.lit(2)), " ").alias("phrase"))), lambda x: x["i"] % 2 == 1)
    return read(spark, d, "benchmark").select("item_id", F.explode(places).alias("x")).select((F.col("item_id") * 1_000_000 + F.col("x.i")).alias("query"), "x.phrase")


@query("t07_cosine_top_k", f"WITH {_NEAREST} SELECT query, id, score, rank FROM dense WHERE rank <= 50")
def t07(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return longs(retrieval.cosine(v, v.filter("id % 50 = 0").withColumnRenamed("id", "query")), "rank")


@query("c17_hybrid_retrieval", f"""WITH {_PHRASES.replace('item_id * 1000000 + i AS query', '(item_id * 1000 + i) * 50 AS query')}, {_NEAREST},
  f AS (SELECT query, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query, id, rank FROM lexical WHERE rank <= 50 UNION ALL SELECT query, id, rank FROM dense WHERE rank <= 50) GROUP BY ALL)
SELECT query, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 5""")
def c17(spark: SparkSession, d: str) -> DataFrame:
    titles = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = F.col("query")
    asked = phrase_queries(spark, d).withColumn("query", (F.floor(q / 1_000_000) * 1000 + q % 1_000_000) * 50)
    return longs(retrieval.hybrid(titles, v, asked, v.filter("id % 50 = 0").withColumnRenamed("id", "query")).withColumn("score", F.round("score", 6)), "rank")


# text and merging
@query("s16_page_fields", r"""WITH p AS (SELECT page_id, 'Url : ' || coalesce(url, '') || ' Page : ' || page_id || ' [n' || page_id || '] Label : x' AS t, url FROM pages)
SELECT page_id, nullif(trim(url), '') AS url, CAST(page_id AS VARCHAR) AS number, 'n' || page_id AS bracketed, 'x' AS label, NULL AS nothing FROM p""")
def s16(spark: SparkSession, d: str) -> DataFrame:
    labels = ("Url", "Page", "Label")
    html = F.concat(F.lit("<p>Url : <b>"), F.coalesce("url", F.lit("")), F.lit("</b><script>Page : 0</script> Page : "), "page_id", F.lit(" [n"), "page_id", F.lit("]<br>Label : x</p>"))
    plain = text.strip_markup(html)
    value = lambda label: text.labelled_value(plain, label, labels)
    page = value("Page")
    return read(spark, d, "pages").select("page_id", value("Url").alias("url"), F.regexp_extract(page, r"^(\d+)", 1).alias("number"), F.regexp_extract(page, r"\[(.*?)\]", 1).alias("bracketed"), value("Label").alias("label"), value("Other").alias("nothing"))


@query("f15_strip_markup", r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g') AS t FROM pages), b AS (SELECT page_id, regexp_replace(t, '(?is)<style\b.*?</style>', ' ', 'g') AS t FROM a), c AS (SELECT page_id, regexp_replace(t, '<[^>]*>', ' ', 'g') AS t FROM b),
  e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS t FROM c)
SELECT page_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM e""")
def f15(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", text.strip_markup(F.col("html")).alias("text"))


@query("s17_merge_search", "SELECT l_orderkey AS record, (list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey))[1] AS first_part, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS tiers, count(DISTINCT l_suppkey) AS genes FROM lineitem GROUP BY l_orderkey")
def s17(spark: SparkSession, d: str) -> DataFrame:
    hits = read(spark, d, "lineitem").withColumn("position", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    out = merge.merge_hits(hits, "l_orderkey", "l_suppkey", "l_returnflag", "position", ["l_partkey"])
    return out.select(F.col("l_orderkey").alias("record"), F.col("l_partkey").alias("first_part"), F.array_join("tiers", ",").alias("tiers"), F.size("genes").cast("long").alias("genes"))


@query("s18_missing_references", "SELECT c_custkey AS id FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey")
def s18(spark: SparkSession, d: str) -> DataFrame:
    return merge.missing_references(read(spark, d, "customer").select(F.col("c_custkey").alias("id")), read(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")), "id")


@query("s19_dedupe_first", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def s19(spark: SparkSession, d: str) -> DataFrame:
    return merge.first_by(read(spark, d, "orders"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("w09_last_write_wins", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def w09(spark: SparkSession, d: str) -> DataFrame:
    return merge.last_write(read(spark, d, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("a14_ingestion_report", """SELECT 'l_returnflag' AS dimension, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY l_linestatus
UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY l_linenumber UNION ALL SELECT 'all', NULL, count(*) FROM lineitem""")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return merge.report(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber")


@query("a16_first_use_dates", "SELECT o_custkey, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_use FROM orders GROUP BY o_custkey")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return merge.first_use(read(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date")), "o_custkey", "day").withColumn("first_use", F.col("first_use").cast("string"))


@query("p06_phrase_flags", r"SELECT doc_id, regexp_matches(lower(text), '(^|[^0-9a-z])(the|und|pour|los)($|[^0-9a-z])') AS flag FROM documents")
def p06(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.has_phrase(F.col("text"), ("the", "und", "pour", "los")).alias("flag"))


# a name counts unless each of its places has a negation right before it
_NEGATED = "|".join(n.replace(" ", r"\s+") for n in policy.NEGATIONS)


@query("f10_title_names", rf"SELECT doc_id, len(regexp_extract_all(lower(text), '\bthe\b')) > len(regexp_extract_all(lower(text), '(?:{_NEGATED})\s{{{{0,24}}}}\bthe\b')) AS names FROM documents".replace("{{", "{").replace("}}", "}"))
def f10(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.names_any(F.col("text"), ["the"]).alias("names"))


@query("p24_primary_claim", r"""WITH t AS (SELECT doc_id, lower(text) AS t, source FROM documents)
SELECT doc_id, CASE WHEN NOT regexp_matches(t, '(^|[^0-9a-z])the($|[^0-9a-z])') THEN 'does not name the gene' WHEN NOT regexp_matches(t, '(^|[^0-9a-z])(is|was)($|[^0-9a-z])') THEN 'no regulatory verb' WHEN NOT regexp_matches(t, '(^|[^0-9a-z])and($|[^0-9a-z])') THEN 'no phenotype term'
  WHEN regexp_matches(t, '(^|[^0-9a-z])this($|[^0-9a-z])') THEN 'review-like title' WHEN source = 'src1' THEN 'publication type' END AS reason FROM t""")
def p24(spark: SparkSession, d: str) -> DataFrame:
    docs, title = read(spark, d, "documents"), F.col("text")
    return docs.select("doc_id", text.primary_claim(title, text.has_phrase(title, ("the",)), ("is", "was"), ("and",), ("this",), F.concat_ws("; ", F.lit("article"), "source"), ("src1",)).alias("reason"))


@query("p08_parse_numeric", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN value ELSE round(value * 1000, 2) END AS number FROM events")
def p08(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.lit(" - ")).when(k == 1, F.concat(F.lit(" "), F.col("value").cast("string"))).otherwise(F.format_number(F.col("value") * 1000, 2))
    return e.select("event_id", scalars.number(raw).alias("number"))


@query("p04_publication_date", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS DATE) + 1 END AS VARCHAR) AS date, CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN 1 END AS rule FROM orders")
def p04(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 3, F.col("o_orderdate").cast("date")
    online = F.when(k == 0, day.cast("string")).otherwise(F.date_format(day, "yyyy-MM"))  # a month is no day
    printed = F.when(k == 1, F.date_add(day, 1).cast("string")).otherwise(F.date_format(day, "yyyy"))
    out = read(spark, d, "orders").select("o_orderkey", scalars.first_day(online, printed).alias("x"))
    return out.select("o_orderkey", F.col("x.date").cast("string").alias("date"), F.col("x.rule").cast("long").alias("rule"))


@query("a10_essential_traps", "SELECT l_partkey AS entity, count(*) AS lines, count(*) FILTER (WHERE l_quantity > 20) AS essential_lines, round(avg(-l_quantity), 4) AS mean_effect FROM lineitem GROUP BY l_partkey HAVING count(*) >= 10 AND count(*) FILTER (WHERE l_quantity > 20) >= 0.7 * count(*)")
def a10(spark: SparkSession, d: str) -> DataFrame:
    effects = read(spark, d, "lineitem").select(F.col("l_partkey").alias("entity"), (-F.col("l_quantity")).alias("effect"))
    return traps.essential_traps(effects, least_lines=10, most=-20.5).drop("answer", "fraction").withColumn("mean_effect", F.round("mean_effect", 4))


@query("a09_association_traps", """SELECT l_partkey AS entity, round(min(l_discount + 0.001), 6) AS best_p, count(*) AS n, count(DISTINCT l_suppkey) AS accessions FROM lineitem ANTI JOIN (SELECT p_partkey FROM part WHERE p_size > 25) ON p_partkey = l_partkey WHERE l_discount + 0.001 < 0.005 GROUP BY l_partkey""")
def a09(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_partkey").alias("entity"), (F.col("l_discount") + 0.001).alias("p"), F.col("l_suppkey").alias("accession"), F.col("l_orderkey").alias("record"))
    known = read(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("entity"))
    return traps.association_traps(rows, known, P_MOST).select("entity", F.round("best_p", 6).alias("best_p"), "n", "accessions")


@query("c15_run_matrix", f"""WITH {_EV}, {_CUTS}, r AS (SELECT cutoff, entity, ab, CASE ab WHEN 'uniform weight' THEN 0.05 ELSE weight END AS weight, direction FROM ev JOIN cuts ON date < cutoff CROSS JOIN (VALUES ('full'), ('uniform weight'), ('no literature')) t(ab) WHERE NOT (ab = 'no literature' AND kind = 'literature')),
  c AS (SELECT cutoff, ab, entity, round(1 / (1 + exp(-({_PRIOR} + sum(direction * weight * 0.85)))), 6) AS confidence FROM r GROUP BY ALL)
SELECT CAST(cutoff AS VARCHAR) AS cutoff, ab AS ablation, count(*) AS claims, count(*) FILTER (WHERE confidence >= 0.25) AS confident, round(avg(confidence), 5) AS mean_confidence FROM c GROUP BY ALL""")
def c15(spark: SparkSession, d: str) -> DataFrame:
    runs = F.array(*[F.lit(x) for x in ("full", "uniform weight", "no literature")])
    e = slices.asof(evidence(spark, d), CUTS).withColumn("ablation", F.explode(runs))
    e = e.filter(~((F.col("ablation") == "no literature") & (F.col("kind") == "literature"))).withColumn("weight", F.when(F.col("ablation") == "uniform weight", 0.05).otherwise(F.col("weight")))
    out = ledger.roll_up(e, ["cutoff", "ablation", "entity"])
    return out.groupBy(F.col("cutoff").cast("string").alias("cutoff"), "ablation").agg(F.count("*").alias("claims"), F.count_if(F.col("confidence") >= 0.25).alias("confident"), F.round(F.avg("confidence"), 5).alias("mean_confidence"))


@query("j10_neighbors", "SELECT o_custkey AS start, 'PLACED' AS edge_type, o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS effective_date FROM orders SEMI JOIN customer ON c_custkey = o_custkey")
def j10(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    starts = read(spark, d, "customer").select(F.col("c_custkey").alias("start"))
    edges = o.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.lit("PLACED").alias("type"))
    nodes = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("effective_date"))
    return graph.neighbors(edges, nodes, starts, "PLACED").withColumn("effective_date", F.col("effective_date").cast("string"))


@query("t01_typed_listing", "SELECT id, CAST(effective_date AS VARCHAR) AS effective_date FROM (SELECT 'o' || o_orderkey AS id, CAST(o_orderdate AS DATE) AS effective_date FROM orders) ORDER BY effective_date, id LIMIT 50")
def t01(spark: SparkSession, d: str) -> DataFrame:
    return graph.listing(graph_tables(spark, d)[0], "Order", 50).select("id", F.col("effective_date").cast("string").alias("effective_date"))


@query("a11_evidence_counts", """WITH p AS (SELECT l_partkey AS entity, count(*) FILTER (WHERE l_returnflag = 'R') AS publications, count(*) FILTER (WHERE l_linestatus = 'O') AS measurements FROM lineitem GROUP BY l_partkey)
SELECT p_partkey AS entity, coalesce(publications, 0) AS publications, coalesce(measurements, 0) AS measurements FROM part LEFT JOIN p ON p_partkey = entity""")
def a11(spark: SparkSession, d: str) -> DataFrame:
    m = measurements(spark, d)
    entities = read(spark, d, "part").select(F.col("p_partkey").alias("entity"), F.concat(F.lit("P"), "p_partkey").alias("symbol"))
    pubs = m.select((F.col("assay") == "R").alias("tier"), F.array(F.concat(F.lit("P"), "entity")).alias("matched"))
    return traps.evidence_counts(entities, pubs, m.filter("system = 'O'")).select("entity", "publications", "measurements")


@query("a12_postdates_traps", f"""WITH {_EV}, {_TRUTH}, n AS (SELECT entity, count(*) FILTER (WHERE tier AND date < DATE '2024-01-04') AS p, count(*) FILTER (WHERE kind = 'composition' AND date < DATE '2024-01-04') AS m FROM ev GROUP BY entity)
SELECT entity, date_diff('day', DATE '2024-01-04', established) AS days_after FROM truth JOIN n USING (entity) WHERE established >= DATE '2024-01-04' AND p < 3 AND m = 0""")
def a12(spark: SparkSession, d: str) -> DataFrame:
    e = evidence(spark, d)
    early = e.filter(F.col("date") < F.lit("2024-01-04").cast("date"))
    counts = early.groupBy("entity").agg(F.count_if("tier").alias("publications"), F.count_if(F.col("kind") == "composition").alias("measurements"))
    return longs(traps.postdates_traps(established(spark, d), counts, "2024-01-04").select("entity", "days_after"), "days_after")


@query("a25_evidence_flow", """WITH c AS (SELECT o_orderpriority AS source, o_orderstatus AS outcome, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT source, sum(n) AS s FROM c GROUP BY source)
SELECT CASE WHEN s < 3000 THEN 'other sources' ELSE source END AS source, outcome, CAST(sum(n) AS BIGINT) AS n FROM c JOIN t USING (source) GROUP BY 1, 2""")
def a25(spark: SparkSession, d: str) -> DataFrame:
    counts = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("outcome")).agg(F.count("*").alias("n"))
    return ingest.evidence_flow(counts, 3000)


def title_rows(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("gene"), F.col("o_orderdate").cast("date").alias("date"), k.alias("pmid"), F.when(k % 5 != 0, "no").alias("reason"), (k % 2 == 0).alias("verb"), (k % 3 != 0).alias("phenotype"), (k % 7 == 0).alias("named"))


_TITLES = "t AS (SELECT o_custkey AS gene, CAST(o_orderdate AS DATE) AS date, o_orderkey AS pmid, o_orderkey % 5 = 0 AS good, o_orderkey % 2 = 0 AS verb, o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AS kind FROM orders)"


@query("w11_earliest_establishing", f"WITH {_TITLES} SELECT gene, CAST(date AS VARCHAR) AS date, pmid FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY date, pmid) AS k FROM t WHERE good) WHERE k = 1")
def w11(spark: SparkSession, d: str) -> DataFrame:
    return ingest.discoveries(title_rows(spark, d)).withColumn("date", F.col("date").cast("string"))


@query("w12_near_misses", f"""WITH {_TITLES}, a AS (SELECT *, max(CASE WHEN good THEN 1 END) OVER w AS seen FROM t WHERE verb WINDOW w AS (PARTITION BY gene ORDER BY date, pmid ROWS UNBOUNDED PRECEDING)),
  b AS (SELECT *, CASE WHEN kind AND sum(CAST(kind AS INT)) OVER (PARTITION BY gene ORDER BY date, pmid ROWS UNBOUNDED PRECEDING) <= 6 THEN 'near_miss' ELSE 'rejected' END AS class FROM a WHERE seen IS NULL),
  c AS (SELECT *, row_number() OVER (PARTITION BY gene, class ORDER BY date, pmid) AS place FROM b) SELECT gene, class, place, pmid FROM c WHERE class = 'near_miss' OR place <= 3""")
def w12(spark: SparkSession, d: str) -> DataFrame:
    return longs(ingest.near_misses(title_rows(spark, d)).select("gene", "class", "place", "pmid"), "place")


@query("a27_coverage_report", "SELECT o_custkey AS gene, count(*) AS considered, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS accepted, count(*) FILTER (WHERE o_orderkey % 5 <> 0) AS rejected FROM orders GROUP BY o_custkey")
def a27(spark: SparkSession, d: str) -> DataFrame:
    return ingest.coverage(title_rows(spark, d))


@query("s20_token_cost", "SELECT conv_id, CAST(round(sum(length(text)) * CASE conv_id % 2 WHEN 0 THEN 3.0 ELSE 1.0 END / 1000000 + count(*) * CASE conv_id % 2 WHEN 0 THEN 15.0 ELSE 5.0 END / 1000000, 6) AS DOUBLE) AS cost FROM conversations GROUP BY conv_id")
def s20(spark: SparkSession, d: str) -> DataFrame:
    usage = read(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("input_tokens"), F.count("*").alias("output_tokens"))
    usage = usage.withColumn("model", F.when(F.col("conv_id") % 2 == 0, "large").otherwise("small"))
    prices = spark.createDataFrame([("large", 3.0, 15.0), ("small", 1.0, 5.0)], "model string, input_price double, output_price double")
    return ingest.token_cost(usage, prices)[0].select("conv_id", "cost")


@query("p02_validate_rows", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'label is empty' WHEN c_custkey % 4 = 1 THEN 'unknown type' WHEN c_custkey % 4 = 2 THEN 'pmid is no number' ELSE 'no effective date' END AS problems FROM customer""")
def p02(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    rows = read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("id"), F.when(k != 0, F.col("c_name")).otherwise(" ").alias("label"), F.when(k == 1, "Other").otherwise("Gene").alias("type"), F.lit("{}").alias("attrs"), F.lit("s").alias("source_id"), F.lit("CC0").alias("license"), F.lit("DATED").alias("time_scope"), F.when(k != 3, F.lit("2001-01-01").cast("date")).alias("effective_date"), F.lit(None).cast("date").alias("publication_date"), F.when(k == 2, "PMC1").otherwise(" 12 ").alias("pmid"))
    return ingest.validate(rows).select("c_custkey", F.array_join("problems", ";").alias("problems"))


@query("j22_recalled_claims", f"WITH {_EV}, {_TRUTH} SELECT DISTINCT ev.entity AS claim FROM ev JOIN truth USING (entity) WHERE ev.entity % 4 <> 0")
def j22(spark: SparkSession, d: str) -> DataFrame:
    claims = evidence(spark, d).select("entity", F.col("entity").alias("claim")).distinct()
    grounded = claims.select("claim", (F.col("claim") % 4 == 0).alias("grounded"))
    return grade.recalled(claims, established(spark, d), grounded).select("claim")


@query("t10_eligible_holdouts", "SELECT l_partkey AS entity, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey, p_name HAVING count(*) >= 2 ORDER BY p_name, l_partkey LIMIT 12")
def t10(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_partkey").alias("entity"), F.col("p_name").alias("label"))
    return grade.eligible_holdouts(rows).select("entity", "n")


@query("u03_asked_units", f"{_BASE}, {_HITS} SELECT CAST(cutoff AS VARCHAR) AS cutoff, count(*) AS units FROM (SELECT cutoff, entity FROM decided WHERE outcome <> 'established' UNION SELECT cutoff, entity FROM hits) GROUP BY cutoff")
def u03(spark: SparkSession, d: str) -> DataFrame:
    units = merge.asked_units(decided(spark, d).filter("outcome <> 'established'").select("cutoff", "entity"), truth_by_cutoff(spark, d).select("cutoff", "entity"))
    return units.groupBy(F.col("cutoff").cast("string").alias("cutoff")).agg(F.count("*").alias("units"))


@query("p01_effective_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '0001-01-01' WHEN o_orderkey % 3 = 1 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date FROM orders")
def p01(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 3, F.col("o_orderdate").cast("date")
    date = scalars.effective_date(F.when(k == 0, "VOCABULARY").otherwise("DATED"), F.lit(None).cast("date"), F.when(k == 1, day))
    return read(spark, d, "orders").select("o_orderkey", date.cast("string").alias("date"))


@query("p03_content_hash", """SELECT c_custkey, sha256('["' || c_name || '","' || c_mktsegment || '"]') AS hash FROM customer""")
def p03(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", scalars.content_hash(F.col("c_name"), F.col("c_mktsegment")).alias("hash"))


@query("p11_gwas_pvalue", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount > 0 THEN round(-log10(l_discount), 6) WHEN l_tax > 0 THEN round(-log10(l_tax * 100 * 0.00000001), 6) END AS value FROM lineitem")
def p11(spark: SparkSession, d: str) -> DataFrame:
    p = scalars.association_p(F.col("l_discount"), F.col("l_tax") * 100, F.lit(-8.0))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(scalars.p_strength(p), 6).alias("value"))


@query("j04_attach_dates", "SELECT o_orderstatus, count(*) AS n, CAST(min(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) ELSE CAST(l_shipdate AS DATE) END) AS VARCHAR) AS first FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
def j04(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("pmid"), F.col("l_shipdate").cast("date").alias("own"))
    dates = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("pmid"), F.col("o_orderdate").cast("date").alias("date"))
    dated = resolve.attach_dates(lines, dates, "own").join(o.select(F.col("o_orderkey").alias("pmid"), "o_orderstatus"), "pmid")
    return dated.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("date").cast("string").alias("first"))


@query("j05_attach_license", "SELECT c_mktsegment AS source, upper(substr(c_mktsegment, 1, 2)) AS license, count(*) AS n FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY ALL")
def j05(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").withColumnRenamed("c_mktsegment", "source")
    licenses = c.filter("source <> 'MACHINERY'").select("source", F.upper(F.substring("source", 1, 2)).alias("license")).distinct()
    return merge.attach_license(c, licenses)[0].groupBy("source", "license").agg(F.count("*").alias("n"))


@query("j16_seed_claims", "SELECT 'claim:' || p_partkey AS claim, max(CASE WHEN l_returnflag = 'A' THEN 'SMALL_MOLECULE' END) AS route, CAST(coalesce(max(CASE WHEN l_returnflag = 'R' THEN l_linenumber END), 0) AS BIGINT) AS publications, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS rule_ids FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size > 10 GROUP BY p_partkey")
def j16(spark: SparkSession, d: str) -> DataFrame:
    found = read(spark, d, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("rule_id"), F.when(F.col("l_returnflag") == "A", "SMALL_MOLECULE").alias("route"), F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")).alias("tier_publications"))
    out = ledger.seed_claims(found, read(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("entity")))
    return out.select("claim", "route", "publications", F.array_join("rule_ids", ",").alias("rule_ids"))


def cached_titles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))
    return docs, docs.filter("id % 3 <> 0").withColumn("title", F.when(F.col("id") % 3 == 1, F.col("title")).otherwise(F.concat(F.lit("old "), "title")))


@query("j24_copy_vectors", "SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 1")
def j24(spark: SparkSession, d: str) -> DataFrame:
    titles, vectors = cached_titles(spark, d)
    return merge.current_vectors(vectors, titles).select("id")


@query("j26_embed_backlog", "SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 1")
def j26(spark: SparkSession, d: str) -> DataFrame:
    titles, vectors = cached_titles(spark, d)
    return merge.vector_backlog(titles, vectors).select("id")


@query("w05_rank_answers", "SELECT l_orderkey, l_linenumber, rank FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, (l_linenumber, l_partkey, l_suppkey)) AS rank FROM lineitem)")
def w05(spark: SparkSession, d: str) -> DataFrame:
    answers = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("position"), F.col("l_discount").alias("confidence"))
    return longs(forecast.rank_answers(answers, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "rank"), "rank")


@query("s13_load_rulebook", "SELECT coalesce(b.k, f.k) AS symbol, coalesce(f.e, b.e) AS established, CASE WHEN f.k IS NOT NULL THEN f.r ELSE b.r END AS record, f.k IS NOT NULL AS adjudicated FROM (SELECT c_custkey AS k, c_acctbal > 0 AS e, c_name AS r FROM customer WHERE c_custkey % 5 <> 0) b FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN true END AS e, c_mktsegment AS r FROM customer WHERE c_custkey % 3 = 0) f ON b.k = f.k")
def s13(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.sources.readers import load_rulebook

    c = read(spark, d, "customer")
    book = c.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("symbol"), (F.col("c_acctbal") > 0).alias("established"), F.col("c_name").alias("record"))
    fixes = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("symbol"), F.when(F.col("c_custkey") % 2 == 0, True).alias("established"), F.col("c_mktsegment").alias("record"))
    return load_rulebook(book, fixes)


@query("a17_distinct_lines", "SELECT o_custkey AS line, o_orderpriority AS name FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return merge.first_name(read(spark, d, "orders").select(F.col("o_custkey").alias("line"), F.col("o_orderpriority").alias("name"), "o_orderkey"), "line", "name", "o_orderkey")


@query("a28_bm25_stats", f"SELECT count(*) AS docs, round(avg(len({_TOK})), 6) AS mean_length FROM documents")
def a28(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_stats(read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))).withColumn("mean_length", F.round("mean_length", 6))


@query("w15_rank_fusion", """WITH a AS (SELECT o_custkey AS query, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), b AS (SELECT o_custkey AS query, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders),
  s AS (SELECT query, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY query, id) SELECT query, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def w15(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    o = read(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderdate")
    by = lambda *c: o.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*c, "id")))
    return longs(retrieval.fuse(by(F.desc("o_totalprice")), by(F.col("o_orderdate"))).withColumn("score", F.round("score", 6)), "rank")


@query("p19_axiom_gate", "SELECT CASE WHEN p_size % 5 = 0 THEN 'blank statement' WHEN p_retailprice - 900 > 90 THEN 'confidence outside 0..1' WHEN p_size % 7 = 0 THEN 'no subject' END AS reject_reason, count(*) AS n FROM part GROUP BY ALL")
def p19(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    table = p.select(F.array("p_name").alias("records"), F.when(F.col("p_size") % 5 != 0, F.col("p_name")).alias("statement"), ((F.col("p_retailprice") - 900) / 90).alias("confidence"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("string").alias("phenotype"), F.when(F.col("p_size") % 7 != 0, F.array("p_partkey")).alias("subjects"), F.lit("rule").alias("kind"), F.lit(1.0).alias("weight"))
    return derive.gate(table).groupBy("reject_reason").agg(F.count("*").alias("n"))


@query("c20_date_discoveries", f"WITH {_TITLES}, f AS (SELECT gene, min((date, pmid)) AS x FROM t WHERE good GROUP BY gene) SELECT CAST(year(date) AS BIGINT) AS year, count(*) AS genes FROM (SELECT gene, date FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY date, pmid) AS k FROM t WHERE good) WHERE k = 1) GROUP BY 1")
def c20(spark: SparkSession, d: str) -> DataFrame:
    return ingest.discoveries(title_rows(spark, d)).groupBy(F.year("date").cast("long").alias("year")).agg(F.count("*").alias("genes"))
