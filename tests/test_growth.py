"""Segmented scans over hot keys, and tables that grow by runs exactly once."""

import datetime
import gzip
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark import policy
from tidemark.operators import graph, ledger, retrieval
from tidemark.operators.derive import literature_evidence
from tidemark.operators.scans import in_ranges, running
from tidemark.sources import members, readers, runs

EVIDENCE = "entity string, date date, record long, direction int, weight double, tier boolean, hit boolean"


@pytest.fixture(scope="module")
def hot(spark):
    """One entity with nine tenths of all rows, a null entity, and dates and records in no order."""
    rng, day = random.Random(5), datetime.date(2015, 1, 1)
    names = ["hot"] * 1800 + [None] * 20 + [f"e{i % 30}" for i in range(180)]
    rows = [(n, day + datetime.timedelta(rng.randrange(40)), i, rng.choice((1, -1)), round(rng.random(), 3), rng.random() < 0.5, rng.random() < 0.85) for i, n in enumerate(names)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, EVIDENCE)


def in_order(rows, entity):
    return sorted((r for r in rows if r[0] == entity), key=lambda r: (r[1], r[2]))


def test_hot_entity_lies_in_many_ranges(hot):
    rows, table = hot
    sizes = [r["count"] for r in in_ranges(table, ["entity", "date", "record"], "part", 8).groupBy("part").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 2 * len(rows) / 8


def test_revise_over_ranges(hot):
    rows, table = hot
    got = {(r["entity"], r["record"]): r for r in ledger.revise(table, ["entity"], parts=8).collect()}
    assert len(got) == len(rows)
    for entity in {r[0] for r in rows}:
        total = ledger.PRIOR
        for seq, r in enumerate(in_order(rows, entity), 1):
            row, delta = got[entity, r[2]], r[3] * r[4] * policy.EVIDENCE_STRENGTH
            assert (row["seq"], row["prior"], row["posterior"]) == (seq, pytest.approx(total), pytest.approx(total + delta))
            total += delta


def test_increments_over_ranges(hot):
    rows, table = hot
    papers = {(r["entity"], r["record"]): r for r in ledger.literature_increments(table, ["entity"], parts=8).collect()}
    hits = {(r["entity"], r["record"]): r for r in ledger.essentiality_increments(table, ["entity"], parts=8).collect()}
    for entity in {r[0] for r in rows}:
        own = in_order(rows, entity)
        assert [papers[entity, r[2]]["k"] for r in own] == list(range(1, len(own) + 1))
        struck = [r for r in own if r[6]]
        fraction = len(struck) / len(own)
        want = [policy.ESSENTIALITY_CEILING * fraction * math.log((k + 1) / k) / math.log(len(struck) + 1) / policy.EVIDENCE_STRENGTH for k in range(1, len(struck) + 1)]
        found = [hits[entity, r[2]]["weight"] for r in struck if (entity, r[2]) in hits]
        assert found == pytest.approx(want if fraction >= policy.PAN_ESSENTIAL else [])
    assert any(k[0] == "hot" for k in hits) and all(papers[k]["weight"] > 0 for k in papers)


def test_running_skips_nulls_ties_and_takes_any_column(spark):
    rows = spark.createDataFrame([("a", 1, None, 7, 8), ("a", 1, 2, 7, 8), ("a", 2, 3, 7, 8), ("b", 1, None, 7, 8)], "k string, at int, x int, _part int, _head int")
    got = running(rows, ["k"], ["at"], {"s": F.col("x")}, 3)
    assert got.columns == ["k", "at", "x", "_part", "_head", "s", "s_total"]
    assert sorted((r["k"], r["at"], r["s_total"]) for r in got.collect()) == [("a", 1, 5), ("a", 1, 5), ("a", 2, 5), ("b", 1, 0)]
    assert [r["s"] for r in got.filter("at = 2").collect()] == [2]
    assert running(rows.limit(0), ["k"], ["at"], {"s": F.col("x")}).count() == 0


def test_latest_of_a_hot_entity_is_cut_before_the_shuffle(hot):
    rows, table = hot
    out = graph.latest(table, "entity", "date", "record", 5)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["entity"], r["place"]): (r["record"], r["total"]) for r in out.collect()}
    for entity in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == entity), key=lambda r: (-r[1].toordinal(), r[2]))
        assert [got[entity, i] for i in range(1, min(5, len(own)) + 1)] == [(r[2], len(own)) for r in own[:5]]


def test_literature_of_the_tier_comes_first(hot):
    rows, table = hot
    got = {(r["entity"], r["k"]): r["record"] for r in literature_evidence(table, ["entity"], 4).collect()}
    for entity in {r[0] for r in rows}:
        own = [r for r in in_order(rows, entity) if r[5]] or in_order(rows, entity)
        assert [got[entity, k] for k in range(1, min(4, len(own)) + 1)] == [r[2] for r in own[:4]]
    none = table.withColumn("tier", F.lit(None).cast("boolean"))
    assert literature_evidence(none, ["entity"], 4).filter("entity = 'hot'").count() == 4


def test_a_run_is_appended_once(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    rows = spark.range(5).select(F.concat(F.lit("c"), "id").alias("claim"), F.lit(1).alias("seq"))
    assert ledger.read_ledger(spark, path).count() == 0
    assert ledger.append_ledger(rows, path, "r/1 ä") and not ledger.append_ledger(rows, path, "r/1 ä")
    assert ledger.append_ledger(rows, path, "r2")
    assert sorted((r["run_id"], r["claim"]) for r in ledger.read_ledger(spark, path).collect()) == sorted((run, f"c{i}") for run in ("r/1 ä", "r2") for i in range(5))
    assert [r["run_id"] for r in ledger.read_ledger(spark, path, "r2", "c3").collect()] == ["r2"]
    assert ledger.read_ledger(spark, path, "r3").count() == 0


def test_a_crash_before_the_commit_leaves_nothing_visible(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    rows = spark.range(3).select(F.col("id").cast("string").alias("claim"), F.lit(1).alias("seq"))
    lost = runs.stage(rows, path, "r1")
    assert runs.read(spark, path) is None
    late, won = runs.stage(rows.limit(1), path, "r1"), runs.stage(rows, path, "r1")
    assert runs.commit(spark, path, "r1", won) and not runs.commit(spark, path, "r1", late)
    assert runs.committed(spark, path) == {"r1": won} and runs.read(spark, path).count() == 3
    assert lost != late and runs.sweep(spark, path) == 2 and runs.read(spark, path, "r1").count() == 3


def test_hit_files_are_chosen_by_name(spark, tmp_path):
    line = "7\t{}\tT\tAA\tp|q\t0.1\t-\t-\tYES\n"
    for name, n in (("SCREEN_7-b", 400), ("SCREEN_7-a [x]{1}", 2), ("SCREEN_8-a", 3), ("SCREEN_x-a", 9), ("notes", 9)):
        (tmp_path / f"{name}.tab.txt").write_text("#head\n" + "".join(line.format(i) for i in range(n)))
    chosen = readers.hit_files(spark, str(tmp_path))
    assert {(r["screen_id"], r["path"].rsplit("/", 1)[1]) for r in chosen.collect()} == {(7, "SCREEN_7-a [x]{1}.tab.txt"), (8, "SCREEN_8-a.tab.txt")}
    hits = readers.read_hits(spark, str(tmp_path))
    assert len(hits.inputFiles()) == 2 and chosen.agg(F.sum("bytes")).first()[0] < 400
    assert sorted((r["screen_id"], r["IDENTIFIER_ID"]) for r in hits.collect()) == [(7, "0"), (7, "1"), (8, "0"), (8, "1"), (8, "2")]
    (tmp_path / "none").mkdir()
    assert readers.read_hits(spark, str(tmp_path / "none")).count() == 0


def test_a_gzip_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(members, "MEMBER", 200)
    folder = f"file://{tmp_path}/nodes.jsonl.gz"
    values = [f'{{"id": "é{i}"}}' for i in range(300)] + ["", "x" * 1000, "x" * 1000]
    lines = spark.createDataFrame([(v,) for v in [*values, None]], "value string").coalesce(1)
    for rows, n in ((lines.limit(3), 3), (lines, len(values))):  # the second write replaces the first
        index = members.write_lines(rows, folder)
        assert index.agg(F.sum("lines")).first()[0] == n
    file, = [p for p in (tmp_path / "nodes.jsonl.gz").iterdir() if p.suffix == ".gz"]
    assert sorted(gzip.decompress(file.read_bytes()).decode().split("\n")[:-1]) == sorted(values)  # one stream to any other reader
    assert sorted(r["value"] for r in spark.read.text(folder).collect()) == sorted(values)
    got = members.read_lines(spark, folder).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["value"] for r in got) == sorted(values) and len({r["task"] for r in got}) > 2
    assert members.write_lines(lines.filter("value IS NULL"), folder).count() == 0 and members.read_lines(spark, folder).count() == 0


def test_snapshots_with_and_without_an_index(spark, tmp_path):
    rows = spark.range(40).select(*[(F.concat(F.lit("n"), "id") if c == "id" else F.to_date(F.lit("2001-02-03")) if c == "effective_date" else F.lit(None)).alias(c) for c in ("id", "label", "effective_date")])
    clean = lambda t: t.withColumn("findings", F.array().cast("array<string>"))
    path = f"file://{tmp_path}/s"
    assert readers.write_snapshot({"nodes": rows, "edges": rows.limit(7), "exclusions": rows.limit(0)}, path, clean) == {"nodes": 40, "edges": 7, "exclusions": 0}
    nodes, edges, exclusions = readers.read_snapshot(spark, path)
    assert (nodes.distinct().count(), edges.count(), exclusions.count()) == (40, 7, 0) and nodes.agg(F.min("effective_date")).first()[0] == datetime.date(2001, 2, 3)
    (tmp_path / "t").mkdir()
    for name in ("nodes", "edges", "exclusions"):
        (tmp_path / "t" / f"{name}.jsonl.gz").write_bytes(gzip.compress(b'{"id": "a", "source": "s"}\n'))
    assert [t.count() for t in readers.read_snapshot(spark, f"file://{tmp_path}/t")] == [1, 1, 1]


def test_files_of_any_length_are_verified(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(members, "WHOLE", 1000)
    monkeypatch.setattr(members, "CHUNK", 64)
    sizes = {"empty": 0, "small": 900, "edge": 1000, "large [1] é": 1001, "larger": 5000}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(random.Random(n).randbytes(n))
    want = {name: hashlib.sha256(random.Random(n).randbytes(n)).hexdigest() for name, n in sizes.items()}
    found = members.digests(spark, f"file://{tmp_path}").union(members.empty_files(spark, f"file://{tmp_path}"))
    assert {r["path"].rsplit("/", 1)[1]: (r["length"], r["sha256"]) for r in found.collect()} == {n: (sizes[n], want[n]) for n in sizes}
    manifest = spark.createDataFrame([*want.items(), ("gone", "0")], "path string, sha256 string").withColumn("sha256", F.when(F.col("path") == "larger", "0").otherwise(F.col("sha256")))
    assert {tuple(r) for r in readers.verify_snapshot(spark, f"file://{tmp_path}", manifest).collect()} == {("gone", "missing"), ("larger", "differs")}


def test_phrases_of_any_length_against_a_plain_search(spark):
    rng = random.Random(11)
    titles = [(i, " ".join(rng.choice(("a", "b", "c", "A", "d-e")) for _ in range(rng.randrange(9)))) for i in range(40)] + [(40, None), (41, "")]
    asked = [(i, p) for i, p in enumerate(["a", "a b", "A, b", "a a", "b c a", "d e d e", "x", "a x", "", "?!", None, "a b"])]
    words = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    want = {}
    for query, phrase in asked:
        p = words(phrase)
        for i, title in titles:
            w = words(title)
            n = sum(w[k : k + len(p)] == p for k in range(len(w) - len(p) + 1)) if p else 0
            if n:
                want[query, i] = (n, len(w))
    held, queries = spark.createDataFrame(titles, "id long, title string"), spark.createDataFrame(asked, "query long, phrase string")
    assert {(r["query"], r["id"]): (r["tf"], r["length"]) for r in retrieval.phrases(held, queries).collect()} == want
    counted = [len(words(t)) for _, t in titles if t is not None]
    scores = {}
    for (query, i), (n, length) in want.items():
        df = sum(q == query for q, _ in want)
        norm = n + 1.2 * (0.25 + 0.75 * length / (sum(counted) / len(counted)))
        scores.setdefault(query, []).append((-round(math.log(1 + (len(titles) - df + 0.5) / (df + 0.5)) * n * 2.2 / norm, 6), i))
    best = {(q, i, k + 1) for q, found in scores.items() for k, (_, i) in enumerate(sorted(found)[:3])}
    assert {(r["query"], r["id"], r["rank"]) for r in retrieval.bm25(held, queries, 3).collect()} == best
    assert retrieval.bm25(held, queries.limit(0)).count() == 0 and retrieval.bm25(held.limit(0), queries).count() == 0
