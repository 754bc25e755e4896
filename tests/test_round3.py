"""Cases of the third round's findings, on hand-made rows."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.operators import grade, ingest
from tidemark.plans import files
from tidemark.sources import documents


def test_decimals_are_those_of_printf(spark):
    values = [0.1235, 0.0625, 0.1875, 0.0005, 0.2495, 1234567.8125, 0.0, 3.0, 0.9995, 0.29949999999999999, 2.0005, -0.0625, 1e12] + [i / 2000 for i in range(1, 2000, 2)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("v", rules.places(F.col("v"), 3).alias("s"), rules.explain_weight(("w", F.col("v"))).alias("w")).collect()
    assert {r["v"]: (r["s"], r["w"]) for r in got} == {v: ("%.3f" % v, "w=%.2f" % v) for v in values}
    reason = spark.range(1).select(rules.refusal_reason(F.lit(0.1235), F.lit(0.1)).alias("a"), rules.refusal_reason(F.lit(0.5), F.lit(0.0625)).alias("b")).first()
    assert reason["a"] == f"confidence {0.1235:.3f} is below 0.25" and reason["b"].startswith("strongest support 0.062 is below")


def test_an_object_without_records_has_no_untraceable_one(spark):
    named = spark.createDataFrame([("a", ["1", "9"]), ("b", []), ("c", None), ("d", [None])], "object string, record_ids array<string>")
    nodes = spark.createDataFrame([("1", None), ("2", "CC0")], "id string, license string")
    assert tuple(grade.trace_records(named, nodes).first()) == (4, 2, 1, 1)


def test_truth_of_every_answer_is_not_broadcast(spark):
    ranked = spark.range(5000).select((F.col("id") % 100).alias("run"), F.col("id").cast("string").alias("entity"), (F.col("id") % 50 + 1).alias("rank"))
    truth = ranked.filter("rank = 2").select("run", "entity")
    out = grade.ranking_metrics(ranked, truth, ["run"])
    assert out.agg(F.sum("hits")).first()[0] == truth.count()
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_perturbed_gene_counts_once_but_keeps_its_edges(spark):
    rows = spark.createDataFrame([(1, 5, "crispri"), (2, 5, "knockout"), (3, 5, "crispri"), (3, 6, "crispri")], "screen_id long, gene long, perturbation string")
    tested = rows.selectExpr("*", "concat('m', screen_id, ':', gene) AS id", "'s' AS system", "cast(screen_id AS string) AS pmid", "DATE '2012-01-01' AS date")
    edges = ingest.screen_edges(tested).withColumn("id", F.concat_ws("|", "type", "src", "dst")).distinct()
    assert {r["src"] for r in edges.filter("type = 'PERTURBS' AND dst = 'gene:5'").collect()} == {"perturbation:crispri", "perturbation:knockout"}
    counted = {r["type"]: r["count"] for r in files.gene_edges(edges, "id").groupBy("type").count().collect()}
    assert counted == {"SCREEN_TESTED": 4, "MEASURED_IN": 4, "PERTURBS": 2, "REPORTS": 4}


def test_screens_are_few_files_and_hits_are_not_written_for_them(spark, monkeypatch):
    monkeypatch.setattr(files, "hit_tables", None)
    screens = files.read_screens(spark, "/root/testdata/sf0.001")
    assert len(screens.inputFiles()) == 1 and screens.count() > 5


def test_elements_of_ranges_cut_anywhere(spark):
    body = {f"k{i}": [f'a,"b\\{"]" * (i % 3)}é,', {"x": [i, {}], "y": "\\\\"}, "", []] for i in range(40)}
    text, found = json.dumps(body, ensure_ascii=False), {}
    chunks = text.split(",")
    for size in (1, 2, 7, 1000):
        rows = [(f"f{size}", i // size, c) for i, c in enumerate(chunks)]
        for f in sorted({r[0] for r in rows}):
            batches = lambda more: [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(*r, *more.get(r[1], ())) for r in rows[i : i + 5]])], names=["file", "block", "value", *(["in_string", "depth"] if more else [])]) for i in range(0, len(rows), 5)]
            effects = {r["block"]: r for b in documents.effects_of(batches({})) for r in b.to_pylist()}
            state, states = (False, 0), {}
            for block in sorted(effects):
                states[block], e = state, effects[block]
                state = (e["open1"], state[1] + e["depth1"]) if state[0] else (e["open0"], state[1] + e["depth0"])
            assert state == (False, 0)
            parts = [r for b in documents.parts_of(batches(states)) for r in b.to_pylist()]
            whole = ",".join(("" if r["begins"] else "\0") + r["text"] for r in sorted(parts, key=lambda r: (r["block"], r["k"]))).replace(",\0", ",")
            assert json.loads("{" + whole + "}") == body and sum(r["begins"] for r in parts) == sum(r["ends"] for r in parts) == 40
