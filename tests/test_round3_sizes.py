"""Findings of the third round on how work grows: what once met in one task, or was read more often than needed."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import ingest, slices
from tidemark.plans import driver, files, jobs, whole
from tidemark.sources import documents, readers

SMALLEST = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_titles_are_matched_where_they_are(spark):  # F14
    rows = [("1", "5", "not THE", "2010-03-01", ["THE", "THE", "DER"]), ("2", "5", "the und", "2010-03-02", ["THE"]), ("3", None, "the", "2010-03-03", ["THE"]), ("4", None, "und", "2010-03-03", ["DER"]), ("5", "6", "und the", "2010-03-04", ["THE", "NEW", "DER"]), ("6", "7", None, "2010", None)]
    table = spark.createDataFrame(rows, "id string, pmid string, title string, firstPublicationDate string, matched_genes array<string>").selectExpr("*", "cast(null AS string) AS print_publication_date", "array('x') AS matched_tiers", "0 AS file_order", "0 AS position").withColumn("position", F.col("id").cast("long"))
    out = ingest.publication_rows(table, {"THE": ["the"], "DER": ["und"]})
    got = sorted((r["source_id"], r["genes"], r["reject_reason"]) for r in out.collect())
    assert got == [("3", [], "malformed_record"), ("4", [], "malformed_record"), ("5", [], None), ("6", ["DER", "THE"], None), ("7", [], "unresolvable_date")]
    assert "hashpartitioning(symbol" not in plan(out) and "hashpartitioning(pmid" in plan(out)
    assert "title" not in "".join(x for x in plan(out.select("source_id", "genes")).splitlines() if "Exchange" in x or "Window" in x)
    assert [r["genes"] for r in ingest.publication_rows(table, {}).collect()] == [[]] * 5


def test_a_negation_is_looked_for_only_before_a_term(spark):  # F24, F14
    new, body = text.names_pattern(["und", "HBF-1"]), f"{text.term_pattern('HBF-1')}|{text.term_pattern('und')}"
    assert new.startswith(f"(?i)(?={body})")
    titles = ["und", "not und", "not   und und", "hbf1 x", "no hbf 1", "xund", "without und, und", "non-und", "", "lack of und " * 3, "rather than HBF-1"]
    old = new.replace(f"(?={body})", "", 1)
    got = spark.createDataFrame([(t,) for t in titles], "t string").select(F.regexp_count("t", F.lit(new)), F.regexp_count("t", F.lit(old)), F.col("t").rlike(old), text.names_any(F.col("t"), ["und", "HBF-1"])).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got) and {r[3] for r in got} == {True, False}


def test_small_documents_are_cut_in_one_pass(spark, tmp_path, monkeypatch):  # F12, F26
    bodies = {"a": [1, "x,]", {"y": ["\\\""]}], "b": [], "c": {"k": [1, 2], "l": "}"}, "d": [""]}
    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=None if name == "a" else 1))
    (tmp_path / "empty.json").write_text("")
    monkeypatch.setattr(documents, "range_elements", None)
    rows = documents.read_elements(spark, str(tmp_path)).collect()
    got = {n: [json.loads("{" + t + "}" if n == "c" else t) for _, t in sorted((r["position"], r["text"]) for r in rows if r["file"].endswith(f"/{n}.json"))] for n in bodies}
    assert got == {**bodies, "c": [{"k": [1, 2]}, {"l": "}"}]} and len(rows) == 6
    monkeypatch.setattr(documents, "WHOLE", 8)
    with pytest.raises(TypeError):
        documents.read_elements(spark, str(tmp_path))


def test_associations_are_files_of_one_folder(spark):  # F12
    path = files.association_file(spark, SMALLEST)
    names = spark.read.format("binaryFile").load(path)
    boxes = driver.read(spark, SMALLEST, "orders").select(F.floor(F.col("o_orderkey") / files.DOCUMENT)).distinct().count()
    assert names.filter("length > 0").count() == boxes
    assert readers.read_associations(spark, path).count() == driver.read(spark, SMALLEST, "orders").count()


def test_a_large_table_is_more_documents_not_a_larger_one(spark, monkeypatch):  # F13
    monkeypatch.setattr(files, "GENES", 30)
    before = {r["symbol"]: (r["lines"], r["effect"]) for r in files.s09(spark, SMALLEST).collect()}
    opened, real = [], readers.read_essentiality
    monkeypatch.setattr(readers, "read_essentiality", lambda s, p: opened.append(p) or real(s, p))
    got = {r["symbol"]: (r["lines"], r["effect"]) for r in files.s09_one(spark, SMALLEST).collect()}
    boxes = driver.read(spark, SMALLEST, "part").select(F.floor(F.col("p_partkey") / 30)).distinct().count()
    assert got == before and spark.read.format("binaryFile").load(opened[-1]).count() == boxes > 5


def test_a_phenotype_is_not_one_tasks_share(spark):  # F20, F21, F22, F16, F18, F19, F23
    t = whole.tables(spark, SMALLEST)
    rows = jobs.weighed_rows(t["measurements"], t["phenotypes"], ["cutoff"], whole.P_MOST, uniform=True)
    assert "Exchange hashpartitioning" not in plan(rows) and "BroadcastHashJoin" in plan(rows)
    assert rows.filter("trait_family IS NULL OR weight <> 1").count() == 0 and rows.count() == t["measurements"].count()
    unknown = jobs.weighed_rows(t["measurements"], t["phenotypes"].limit(0), ["cutoff"], whole.P_MOST, uniform=True)
    assert {(r["directness"], r["trait_family"]) for r in unknown.select("directness", "trait_family").distinct().collect()} == {("proxy", None)}


def test_rules_are_found_once(spark):  # F16, F18, F19, F23
    found, t = whole.rule_set(spark, SMALLEST)
    for table in (found.weighed, found.genetic, found.essential, found.functional, found.literature, found.composed):
        assert table.inputFiles() and "Exchange" not in plan(table) and "record_ids" not in table.columns
    assert found.genetic.agg(F.sum("records")).first()[0] == found.records.filter("kind = 'genetic'").count() > 0


def test_missing_ends_are_flags(spark):  # F27, F25
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    edges = spark.createDataFrame([("1", "a", "b"), ("2", "x", "b"), ("3", "a", "y"), ("4", "x", "y"), ("5", None, "a"), ("3", "x", "a"), (None, "a", "y")], "id string, src string, dst string")
    out = slices.dangling(nodes, edges)
    assert {r["id"]: r["missing"] for r in out.collect()} == {"2": "src", "3": "dst+src", "4": "dst+src", "5": "src", None: "dst"} and out.count() == 5
    assert "ObjectHashAggregate" not in plan(out)


def test_a_customer_with_many_orders_is_several_documents(spark, tmp_path, monkeypatch):  # F26
    monkeypatch.setattr(files, "ROWS", 100, raising=False)
    customer = F.when(F.col("id") < 900, 7).when(F.col("id") < 910, F.col("id") - 890).otherwise(2_500)
    orders = spark.range(915).select(F.col("id").alias("o_orderkey"), customer.cast("long").alias("o_custkey"), F.lit("1996-01-02").cast("timestamp").alias("o_orderdate"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    path = files.evidence_file(spark, str(tmp_path))
    found = [json.loads(r["value"]) for r in spark.read.text(path, wholetext=True).collect()]
    rows = [[e["id"] for traits in f.values() for e in traits["EFO_1"]["evidences"]["rows"]] for f in found]
    assert sorted(i for ids in rows for i in ids) == sorted(f"ev{i}" for i in range(915))
    assert sorted(map(len, rows))[0] == 5 and max(map(len, rows)) < 150 and len(rows) == 11
    got = {r["symbol"]: (r["n"], r["dated"]) for r in files.s10(spark, str(tmp_path)).collect()}
    assert got == {"C7": (900, 225), "C2500": (5, 1), **{f"C{i - 890}": (1, int(i % 4 == 0)) for i in range(900, 910)}}


def test_documents_are_dealt_out_once_to_as_many_tasks_as_they_need(spark, monkeypatch):  # F26
    monkeypatch.setattr(files, "DOCUMENT", 5)
    orders = driver.read(spark, SMALLEST, "orders").select("o_orderkey", "o_custkey")
    boxes = orders.select(F.floor(F.col("o_custkey") / 5)).distinct().count()
    out = files.dealt(orders, "o_custkey", F.col("o_orderkey"))
    assert out.rdd.getNumPartitions() == boxes // 4 > 4 and out.count() == orders.count()
    grouped = out.groupBy(files.box(F.col("o_custkey")).alias("box"), "page", "o_custkey").agg(F.collect_list("o_orderkey").alias("r")).withColumn("box", files.box(F.col("o_custkey"))).groupBy("box", "page").agg(F.collect_list("r"))
    assert plan(grouped).count("Exchange hashpartitioning") == 2  # the counts' own, and that of the rows
