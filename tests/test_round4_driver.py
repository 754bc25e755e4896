"""Findings of the fourth round: what once went through the driver (F1)."""

from pyspark.sql import functions as F

from tidemark.operators import ingest, resolve, slices
from tidemark.plans import build, driver, files

SMALLEST = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entities_and_ids_are_not_broadcast(spark):  # F1
    entities = driver.part_entities(spark, SMALLEST)
    names = entities.select(F.col("symbol").alias("name")).union(entities.select("entrez"))
    found = resolve.resolve(names, entities)
    assert "Broadcast" not in plan(found) and found.filter("id IS NULL").count() == 0 and found.count() == names.count()
    nodes, edges = driver.graph_tables(spark, SMALLEST)
    assert "Broadcast" not in plan(slices.dangling(nodes.hint("merge"), edges))
    order = lambda t: t.withColumn("load_order", F.lit(0))
    assert "Broadcast" not in plan(build.build_graph([], [order(nodes)], [order(edges)])["edges"])
    _, tested = files.screens(spark, SMALLEST)
    joins = [x for x in plan(tested).splitlines() if "HashJoin" in x]
    assert joins and not any(k in x for x in joins for k in ("k_by_", "k_alias", "k_name", "k_symbol", "in_scope"))
    dates = spark.createDataFrame([("5", "2005-05-05"), ("ev2", "2006-06-06")], "pmid string, date string").withColumn("date", F.col("date").cast("date"))
    evidence = spark.createDataFrame([("ev1", ["PMC1", "5"]), ("ev2", ["PMC1"]), ("ev3", ["6"]), ("ev4", None)], "id string, literature array<string>").selectExpr("*", "'C' AS symbol", "'t' AS trait", "1.0 AS score", "'l' AS datatypeId", "cast(null AS string) AS publicationDate", "cast(null AS int) AS publicationYear")
    rows = ingest.evidence_rows(evidence, dates, "2021-01-01")
    assert "Broadcast" not in plan(rows)
    assert {r["source_id"]: str(r["date"]) for r in rows.collect()} == {"ev1": "2005-05-05", "ev2": "2021-01-01", "ev3": "2021-01-01", "ev4": "2021-01-01"}
