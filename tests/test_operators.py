"""Unit cases of the operators on hand-made rows."""

import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark import policy
from tidemark.functions import rules, scalars, text
from tidemark.operators import derive, forecast, grade, graph, ledger, merge, resolve, retrieval, slices, traps, weigh
from tidemark.sources import readers, redistribution
from tidemark.sources.documents import read_elements

D = datetime.date


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.fixture(scope="module")
def toy(spark):
    nodes = spark.createDataFrame([("g1", "Gene", D(2001, 6, 1)), ("g2", "Gene", D(2001, 6, 1)), ("ph", "Phenotype", D(1, 1, 1)), ("pub", "Publication", D(2013, 3, 22)), ("pre", "Measurement", D(2013, 3, 22)), ("post", "Measurement", D(2018, 6, 1))], "id string, type string, effective_date date")
    edges = spark.createDataFrame([("e1", "REPORTS", "pub", "pre", D(2013, 3, 22)), ("e2", "SUPPORTS", "pre", "post", D(2013, 4, 1))], "id string, type string, src string, dst string, effective_date date")
    return nodes, edges


def test_slice_drops_dangling(toy):
    nodes, edges = toy
    cuts = ["2018-01-01", "2018-06-01", "2018-06-02"]
    n, e = slices.asof(nodes, cuts), slices.asof(edges, cuts)
    got = {str(r["cutoff"]): (r["nodes"], r["edges"], r["dangling"]) for r in slices.manifest(n, e, slices.drop_dangling(n, e)).collect()}
    assert got == {"2018-01-01": (5, 1, 1), "2018-06-01": (5, 1, 1), "2018-06-02": (6, 2, 0)}  # strictly before
    assert slices.leaks(n).isEmpty() and slices.not_in_later(n, cuts[0], cuts[2]).isEmpty()
    assert [r["missing"] for r in slices.dangling(nodes.filter("id <> 'post'"), edges).collect()] == ["dst"]


def test_mask(spark, toy):
    n, e = slices.mask(*toy, spark.createDataFrame([("pre",)], "id string"))
    assert n.count() == 5 and e.isEmpty()


def test_dates_are_never_widened(spark):
    r = one(spark, a=scalars.day(F.lit("2017-1")), b=scalars.day(F.lit("2017")), c=scalars.day(F.lit("2017-01-05T10:00")), d=scalars.day(F.lit("2017-13-45")), e=scalars.first_day(F.lit("2017-05"), F.lit("2017-05-06")))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]["date"], r["e"]["rule"]) == (None, None, D(2017, 1, 5), None, D(2017, 5, 6), 1)


def test_numbers(spark):
    cases = {" 1,234.5 ": 1234.5, "-": None, "": None, "NaN": None, "inf": None, "x": None, "-3e2": -300.0}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", scalars.number(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == cases


def test_p_values(spark):
    r = one(spark, a=scalars.association_p(F.lit(0.0), F.lit(3.0), F.lit(-9.0)), b=scalars.association_p(F.lit(0.0), F.lit(0.0), F.lit(1.0)), c=scalars.significant(F.lit(None).cast("double")), d=scalars.significant(F.lit(1e-9)))
    assert r["a"] == pytest.approx(3e-9) and r["b"] is None and r["c"] is False and r["d"] is True


def test_titles(spark):
    terms = ["HBG1", "gamma-globin", "MBD2"]
    cases = {"HBG1 rises": True, "γ globin levels": True, "gammaglobin": True, "HBG12": False, "effects but not  MBD2 here": False, "MBD2 but not MBD3": True, "without HBG1": False, "": False, None: False}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.coalesce(text.names_any(F.col("t"), terms), F.lit(False)).alias("x")).collect()
    assert {r["t"]: r["x"] for r in got} == cases
    r = one(spark, a=text.has_phrase(F.lit("rate of cell proliferation"), policy.PHENOTYPE_TERMS), b=text.has_phrase(F.lit("an F cell assay"), policy.PHENOTYPE_TERMS), c=text.usable_terms(F.lit("A1"), F.array(F.lit("abc"), F.lit("abcd"), F.lit("LRF")), ("LRF",)))
    assert (r["a"], r["b"], r["c"]) == (False, True, ["A1", "LRF", "abcd"])


def test_markup(spark):
    r = one(spark, a=text.strip_markup(F.lit("<p>a &amp; b</p><script>x<y</script>\n c")), b=text.labelled_value(F.lit("Author : X Y Source : z"), "Author", ("Author", "Source")))
    assert (r["a"], r["b"]) == ("a & b c", "X Y")


def test_routes(spark):
    f = lambda family=None, locus=None, essential=False, raises=True, cis=False: rules.route(F.lit(family), F.lit(locus), F.lit(essential), F.lit(raises), F.lit(cis))["route"]
    r = one(spark, a=f("Protein kinases"), b=f("BAF complex subunits", cis=True), c=f("BAF complex subunits"), d=f("Zinc fingers"), e=f("kinases", essential=True), g=f("kinases", raises=False), h=f("kinases", "RNA, long non-coding"), i=f())
    assert list(r) == ["SMALL_MOLECULE", "EX_VIVO_SINGLE_EDIT", "EX_VIVO_MULTI_EDIT", "EX_VIVO_SINGLE_EDIT", "NOT_THERAPEUTIC", "NOT_THERAPEUTIC", "EX_VIVO_SINGLE_EDIT", "EX_VIVO_SINGLE_EDIT"]


@pytest.mark.parametrize("confidence, weight, publications, good", [(0.05, 0.0, 0, False), (0.9, 0.01, 2, False), (0.6, 0.0, 5, True), (0.6, 0.0, 4, False), (0.224, 2.0, 0, False), (0.26, 0.31, 0, True)])
def test_claim_gate(spark, confidence, weight, publications, good):
    assert one(spark, x=rules.reportable(F.lit(confidence), F.lit(weight), F.lit(publications), F.lit(None).cast("double")))["x"] is good


@pytest.mark.parametrize("n", [1, 5, 20, 200])
def test_literature_sums_to_log(spark, n):
    rows = spark.range(n).select(F.lit("g").alias("entity"), F.col("id").alias("record"), F.lit(D(2015, 1, 1)).alias("date"), F.lit(True).alias("tier"))
    out = ledger.literature_increments(rows, ["entity"])
    assert out.agg(F.sum("weight")).first()[0] * policy.EVIDENCE_STRENGTH == pytest.approx(math.log(1 + n))
    last = ledger.revise(out, ["entity"]).orderBy(F.desc("seq")).first()
    assert last["posterior"] == pytest.approx(ledger.PRIOR + math.log(1 + n))


@pytest.mark.parametrize("n, hits", [(1, 1), (10, 9), (400, 300), (10, 6)])
def test_essentiality_sums_to_ceiling(spark, n, hits):
    rows = spark.range(n).select(F.lit("g").alias("entity"), F.col("id").alias("record"), F.lit(D(2015, 1, 1)).alias("date"), (F.col("id") < hits).alias("hit"))
    got = ledger.essentiality_increments(rows, ["entity"]).agg(F.sum("weight")).first()[0]
    assert (got or 0) * policy.EVIDENCE_STRENGTH == pytest.approx(1.2 * hits / n if hits / n >= 0.7 else 0)


def test_ledger_telescopes(spark):
    rows = spark.createDataFrame([("g", D(2015, 1, 1), 2, 1, 0.5), ("g", D(2015, 1, 1), 1, -1, 0.2), ("g", D(2014, 1, 1), 9, 1, 1.0)], "entity string, date date, record long, direction int, weight double")
    out = ledger.revise(rows, ["entity"]).orderBy("seq").collect()
    assert [r["record"] for r in out] == [9, 1, 2]
    assert all(a["posterior"] == pytest.approx(b["prior"]) for a, b in zip(out, out[1:])) and out[0]["prior"] == pytest.approx(ledger.PRIOR)


def test_resolution(spark):
    genes = spark.createDataFrame([("1", "HBG1", "3047", None, ["A"], ["OLD"]), ("2", "ACSBG1", None, "E2", ["hBG1", "LRF"], []), ("3", "ZBTB7A", None, None, ["LRF", "X", "X"], None)], "id string, symbol string, entrez string, ensembl string, aliases array<string>, previous array<string>")
    names = spark.createDataFrame([("hbg1",), ("LRF",), ("old",), ("nope",), ("",), ("3047",), ("E2",), ("x",)], "name string")
    got = {r["name"]: (r["id"], r["reason"]) for r in resolve.resolve(names, genes).collect()}
    assert got == {"hbg1": ("1", None), "LRF": (None, "ambiguous 2"), "old": ("1", None), "nope": (None, "unknown"), "": (None, "empty"), "3047": ("1", None), "E2": ("2", None), "x": (None, "ambiguous 2")}
    inside = {r["name"]: r["id"] for r in resolve.resolve_in_graph(names, genes).collect()}
    assert inside == {"hbg1": "1", "LRF": None, "old": None, "nope": None, "": None, "3047": None, "E2": None, "x": "3"}


def test_group_pairs(spark):
    rows = spark.createDataFrame([("a", "toy complex subunits", D(2000, 1, 1)), ("b", "toy complex subunits", D(2005, 1, 1)), ("a", "domain", D(2000, 1, 1)), ("c", "domain", D(2001, 1, 1))], "id string, group string, date date")
    got = {(r["src"], r["dst"], r["date"]) for r in resolve.group_pairs(rows, "complex subunits").collect()}
    assert got == {("a", "b", D(2005, 1, 1)), ("b", "a", D(2005, 1, 1))}


def test_rule_gate(spark):
    rows = [(["r"], "s", 0.5, "increases", "p", ["g"], "k", 1.0), ([], "s", 0.5, None, None, ["g"], "k", 1.0), (["r"], " ", 0.5, None, None, ["g"], "k", 1.0), (["r"], "s", 1.5, None, None, ["g"], "k", 1.0), (["r"], "s", 0.5, "increases", None, ["g"], "k", 1.0), (["r"], "s", 0.5, None, None, [], "k", 1.0), (["r"], "s", 0.5, None, None, [], "corpus", 1.0), (["r"], "s", 0.5, None, None, ["g"], "k", -1.0)]
    df = spark.createDataFrame(rows, "records array<string>, statement string, confidence double, direction string, phenotype string, subjects array<string>, kind string, weight double")
    assert [r["reject_reason"] for r in derive.gate(df).collect()] == [None, "no record", "blank statement", "confidence outside 0..1", "direction without phenotype", "no subject", None, "negative weight"]


def test_weight_uses_defaults(spark):
    r = one(spark, a=weigh.weight(F.lit("human_population"), F.lit("genetic_variant"), F.lit("direct_protein"), F.lit("gwas_association"), F.lit(9), F.lit(True), F.lit(False)), b=weigh.weight(*[F.lit(None).cast("string")] * 4, F.lit(None).cast("int"), F.lit(None).cast("boolean"), F.lit(True)))
    assert r["a"] == 2.0 and r["b"] == 0.01


def test_ranking_and_calibration(spark):
    ranked = spark.createDataFrame([("x", e, i + 1) for i, e in enumerate("ABCDEF")], "k string, entity string, rank int")
    truth = spark.createDataFrame([("x", e) for e in "ADZ"], "k string, entity string")
    r = grade.ranking_metrics(ranked, truth, ["k"]).first()
    assert (r["p_at_5"], r["p_at_10"], r["reciprocal_rank"], r["hits"]) == (0.4, 0.2, 1.0, 2)
    bins = grade.calibration_bins(spark.createDataFrame([("x", 0.1, False), ("x", 1.0, True), ("x", 0.8, False)], "k string, confidence double, hit boolean"), ["k"])
    assert {b["bin"]: b["n"] for b in bins.collect()} == {0: 1, 1: 0, 2: 0, 3: 0, 4: 2}
    assert grade.calibration_error(bins, ["k"]).first()["ece"] == pytest.approx((0.1 + 2 * 0.4) / 3)


def test_bootstrap(spark):
    units = lambda hits: spark.createDataFrame([("x", e, i + 1 if i < 6 else None, e in hits) for i, e in enumerate("ABCDEFGHZ")], "k string, unit string, rank int, hit boolean")
    first, again = (grade.bootstrap_intervals(units("A").repartition(n), ["k"], 500).first() for n in (1, 5))
    assert first == again and first["p_at_5_low"] == 0.0 and 0.4 <= first["p_at_5_high"] <= 0.8
    nothing = grade.bootstrap_intervals(units("Z"), ["k"], 100).first()
    assert list(nothing)[1:5] == [0.0] * 4 and nothing["rate_low"] == 0.0 < nothing["rate_high"]
    # the draws by hand: a drawn unit keeps its place in the ranking, once for each time it is drawn
    hits, n, p5, rr, rate = "AD", 9, [], [], []
    order = [*"ABCDEF", *"GHZ"]
    for r in range(200):
        drawn = [order[i] for i in grade.drawn_of(42, r, n, 0).tolist()]
        ranked = sorted(x for x in drawn if x in "ABCDEF")
        p5.append(sum(x in hits for x in ranked[:5]) / 5)
        rr.append(next((1 / (i + 1) for i, x in enumerate(ranked) if x in hits), 0.0))
        rate.append(sum(x in hits for x in drawn) / n)
    got = grade.bootstrap_intervals(units(hits), ["k"], 200).first()
    for values, name in ((p5, "p_at_5"), (rr, "reciprocal_rank"), (rate, "rate")):
        values.sort()
        assert (got[f"{name}_low"], got[f"{name}_high"]) == (pytest.approx(values[5], abs=1e-6), pytest.approx(values[194], abs=1e-6))


def test_bootstrap_of_many_chunks(spark):
    n, resamples = 3 * grade.SLOTS + 5, 40
    units = spark.range(n).select(F.lit("x").alias("k"), F.col("id").alias("unit"), F.when(F.col("id") < n - 9000, F.col("id") + 1).alias("rank"), (F.col("id") % 7 == 4).alias("hit"))
    first, again = (grade.bootstrap_intervals(units.repartition(m), ["k"], resamples).first() for m in (2, 7))
    assert first == again
    p5, rr, rate, chunks = [], [], [], -(-n // grade.SLOTS)
    for r in range(resamples):
        drawn = [c * grade.SLOTS + i for c in range(chunks) for i in grade.drawn_of(42, r, n, c).tolist()]
        assert len(drawn) == n and max(drawn) < n
        ranked = [i % 7 == 4 for i in drawn if i < n - 9000]
        p5.append(sum(ranked[:5]) / 5)
        rr.append(1 / (ranked.index(True) + 1))
        rate.append(sum(i % 7 == 4 for i in drawn) / n)
    for values, name in ((p5, "p_at_5"), (rr, "reciprocal_rank"), (rate, "rate")):
        values.sort()
        assert (first[f"{name}_low"], first[f"{name}_high"]) == (pytest.approx(values[1], abs=1e-6), pytest.approx(values[38], abs=1e-6))


def test_resamples_share_no_draws():
    n = 2**21
    a, b, c = (grade.drawn_of(42, r, n, chunk) for r, chunk in ((0, 128), (1, 0), (0, 0)))
    assert not any(len(x) == len(y) and (x == y).all() for x, y in ((a, b), (b, c), (a, c)))
    assert sum(len(grade.drawn_of(42, 3, n, i)) for i in range(n // grade.SLOTS)) == n


def test_hits_before_the_first_chunk_count_in_order(spark):
    rows = [(0, 0, 3, 1, 2, [False, True], 2), (1, 0, 4, 3, 4, [True, False, True, True], 1), (0, 1, 1, 0, 0, [], None)]
    states = spark.createDataFrame([("x", *r) for r in rows], "k string, chunk long, resample int, drawn long, hits long, places long, first5 array<boolean>, first long")
    got = {r["resample"]: (r["p_at_5"], r["reciprocal_rank"], r["rate"]) for r in grade.merge_states(states, ["k"]).collect()}
    assert got[0] == (pytest.approx(3 / 5), 0.5, pytest.approx(4 / 7)) and got[1][:2] == (0, 0)


@pytest.mark.parametrize("size", [7, 200, 10**6])
@pytest.mark.parametrize("kind", ["array", "object"])
def test_documents_are_read_in_ranges(spark, tmp_path, size, kind):
    rng = random.Random(size)
    odd = ['a,b', '"', '\\', '{[', ']},', 'é,ü', '\n,', '😀,', "", '\\",']
    value = lambda depth: rng.choice([rng.choice(odd), 1.5, None, True]) if depth > 2 else rng.choice([[value(depth + 1) for _ in range(rng.randint(0, 3))], {rng.choice(odd): value(depth + 1) for _ in range(rng.randint(0, 3))}, rng.choice(odd)])
    documents = [[value(0) for _ in range(n)] for n in (0, 1, 2, 4 if size == 7 else 30)]
    if kind == "object":
        documents = [{f"{i}{rng.choice(odd)}": v for i, v in enumerate(x)} for x in documents]
    for i, x in enumerate(documents):
        (tmp_path / f"{i}.json").write_text(json.dumps(x, ensure_ascii=bool(i % 2), indent=[None, 2][i // 2 % 2]), encoding="utf-8")
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, str(size))
        rows = read_elements(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(setting, before)
    for i, x in enumerate(documents):
        got = sorted((r["position"], r["text"]) for r in rows if r["file"].endswith(f"/{i}.json"))
        assert [p for p, _ in got] == list(range(len(x)))
        read = [json.loads(t) if kind == "array" else json.loads("{" + t + "}") for _, t in got]
        assert read == (x if kind == "array" else [{k: v} for k, v in x.items()])


def test_slots_fold_what_runs_of_their_own_would(spark):
    kinds = ["measurement", "genetic", "literature", "composition"]
    rng = random.Random(8)
    rows = [("c", f"e{i % 9}", kinds[rng.randint(0, 3)], rng.random(), rng.choice([-1, 1]), rng.random() < 0.5, D(2000, 1, 1 + i % 20), f"r{i}") for i in range(200)]
    e = spark.createDataFrame(rows, "k string, entity string, kind string, weight double, direction int, tier boolean, date date, record string")
    keep = F.col("kind") != "literature"
    slots = {"all": (F.col("weight"), F.lit(True)), "even": (F.lit(0.5), F.lit(True)), "flat": (None, F.lit(True)), "some": (F.col("weight"), keep), "none": (F.col("weight"), F.lit(False))}
    got = {(r["ablation"], r["entity"]): tuple(r)[3:] for r in ledger.roll_up_slots(e, ["k", "entity"], slots).select("k", "entity", "ablation", "log_odds", "confidence", "evidence", "max_support", "max_composition", "publications").collect()}
    alone = {"all": ledger.roll_up(e, ["entity"]), "even": ledger.roll_up(e.withColumn("weight", F.lit(0.5)), ["entity"]), "flat": ledger.roll_up(e, ["entity"], flat=True), "some": ledger.roll_up(e.filter(keep), ["entity"])}
    for name, table in alone.items():
        for r in table.collect():
            assert got[name, r["entity"]] == tuple(pytest.approx(r[c], abs=1e-5) if r[c] is not None else None for c in ("log_odds", "confidence", "evidence", "max_support", "max_composition", "publications"))
    assert got["none", "e1"] == (round(ledger.PRIOR, 6), pytest.approx(0.05, abs=1e-6), 0, None, None, 0)


def test_first_ids_are_few_and_distinct(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("k"), (F.col("id") % 999).alias("record"))
    got = {r["k"]: r["record_ids"] for r in merge.first_ids(rows.withColumn("k", F.lit("hot")).union(spark.range(2).select(F.lit("cold"), F.lit(5).cast("long"))), ["k"], 4).collect()}
    assert got == {"hot": sorted(map(str, range(999)))[:4], "cold": ["5"]}
    assert merge.first_ids(rows.limit(0), ["k"], 4).count() == 0


def test_rates_of_what_was_loaded(spark):
    nodes = spark.createDataFrame([("a", "Measurement", "s1", "CC0", 1.0), ("a", "Measurement", "", "CC0", None), ("b", "Gene", "s2", None, None)], "source string, type string, source_id string, license string, value double")
    bad = merge.spurious_rows(nodes)
    assert sorted((r["source"], r["problem"]) for r in bad.collect()) == [("a", "measurement with no value"), ("a", "missing provenance"), ("b", "missing provenance")]
    got = {r["source"]: tuple(r)[1:] for r in merge.loaded_rates(spark.createDataFrame([("a", 4), ("c", 0)], "source string, n long"), nodes, bad).collect()}
    assert got == {"a": (4, 2, 2, 0.5), "b": (0, 1, 1, 0.0), "c": (0, 0, 0, 0.0)}


def test_traps_and_citations(spark):
    t = spark.createDataFrame([("c", "t1", "A", "reject"), ("c", "t2", "B", "refuse"), ("c", "t3", "C", "accept"), ("d", "t4", "A", "reject")], "cutoff string, trap string, entity string, answer string")
    f = spark.createDataFrame([("c", "A", "forecast", 3, 40), ("c", "C", "forecast", 20, 20), ("d", "Q", "refused", None, None)], "cutoff string, entity string, outcome string, rank int, cost_rank int")
    got = {r["trap"]: (r["passed"], r["vacuous"]) for r in grade.trap_outcomes(t, f, ["cutoff"]).collect()}
    assert got == {"t1": (False, False), "t2": (True, False), "t3": (True, False), "t4": (True, True)}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "record_id string")
    cited = spark.createDataFrame([("k", i) for i in ("in", "out", "late", "fake")], "claim string, record_id string")
    status = {r["record_id"]: r["status"] for r in grade.classify_citations(cited, cited.filter("record_id = 'in'"), ids("in", "out"), ids("in", "out", "late")).collect()}
    assert status == {"in": "in_context", "out": "out_of_context", "late": "post_cutoff", "fake": "fabricated"}


def test_walks(spark):
    e = spark.createDataFrame([("a", "b", "X"), ("b", "c", "X"), ("c", "a", "X"), ("b", "d", "REPORTS")], "src string, dst string, type string")
    starts = spark.createDataFrame([("a",)], "start string")
    got = sorted((r["dst"], r["depth"]) for r in graph.chains(e, starts).collect())
    assert got == [("b", 1), ("c", 2), ("d", 2)]
    near = {(r["id"], r["depth"]) for r in graph.provenance(e, starts, ("REPORTS",), 2).collect()}
    assert near == {("a", 0), ("c", 1), ("b", 2)}


def test_fusion_order(spark):
    r = lambda ids: spark.createDataFrame([("q", i, k + 1) for k, i in enumerate(ids)], "query string, id string, rank int")
    assert [x["id"] for x in retrieval.fuse(r(["a", "b"]), r(["c", "b"])).orderBy("rank").collect()] == ["b", "a", "c"]


def test_vectors(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    got = [x["id"] for x in retrieval.cosine(v, spark.createDataFrame([("q", [1.0, 0.0])], "query string, vector array<double>"), 2).orderBy("rank").collect()]
    assert got == [1, 3]
    with pytest.raises(ValueError):
        retrieval.hybrid(None, v.limit(0), None, None)


def test_merging(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 1, "c")], "key string, load int, x string")
    assert sorted(r["x"] for r in merge.last_write(rows, ["key"], "load").collect()) == ["b", "c"]
    assert sorted(r["x"] for r in merge.first_by(rows, ["key"], F.col("load")).collect()) == ["a", "c"]
    ok, lacking = merge.attach_license(rows.withColumnRenamed("key", "source"), spark.createDataFrame([("k", "CC0")], "source string, license string"))
    assert ok.count() == 2 and [r["source"] for r in lacking.collect()] == ["m"]


def test_redistribution(spark):
    df = spark.createDataFrame([({"abstract": "x"}, "a" * 601, "b" * 2000), ({"abstract": None}, "short", "b")], "nested struct<abstract:string>, label string, detail string")
    found = [sorted(r["findings"]) for r in redistribution.scan(df).collect()]
    assert found == [["label: long text", "nested.abstract: forbidden field"], []]


def test_readers(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("\t".join(readers.GENES.replace(" string", "").split(", ")) + "\nHGNC:1\tA1\tn\t\t\t\t2001-01-01\t\t\tx|y\t\t\t\t\t\tg1|g2\t\t\nHGNC:2\tB\tn\t\t\t\t\t\t\t\t\t\t\t\t\t\t\t\n")
    genes = {r["symbol"]: r for r in readers.read_genes(spark, str(tmp_path / "g.tsv")).collect()}
    assert genes["A1"]["aliases"] == ["x", "y"] and genes["A1"]["reject_reason"] is None and genes["B"]["reject_reason"]
    (tmp_path / "c.json").write_text(json.dumps({"CVCL_1": {"name": "n", "category": "Cancer", "species": ["Homo sapiens"], "diseases": [{"term": "d"}]}}))
    cell = readers.read_cell_lines(spark, str(tmp_path / "c.json")).first()
    assert (cell["accession"], cell["diseases"]) == ("CVCL_1", ["d"])
    for n, rows in (("SCREEN_7-a", "#SCREEN_ID\tx\n7\t1\tT\tAA\tp|q\t0.1\t-\t-\tYES\n"), ("SCREEN_7-b", "#h\n7\t2\tT\tBB\t-\t-\t-\t-\tNO\n")):
        (tmp_path / f"BIOGRID-ORCS-{n}.screen.tab.txt").write_text(rows)
    hits = readers.read_hits(spark, str(tmp_path / "*.screen.tab.txt")).collect()
    assert [(r["screen_id"], r["OFFICIAL_SYMBOL"], r["hit"], r["aliases"]) for r in hits] == [(7, "AA", True, ["p", "q"])]
    book = spark.createDataFrame([("A", False, "r1"), ("B", True, "r2")], "symbol string, established boolean, record string")
    fix = spark.createDataFrame([("A", None, "r9"), ("C", True, "r3")], "symbol string, established boolean, record string")
    got = {r["symbol"]: (r["established"], r["record"], r["adjudicated"]) for r in readers.load_rulebook(book, fix).collect()}
    assert got == {"A": (False, "r9", True), "B": (True, "r2", False), "C": (True, "r3", True)}
    rows = spark.createDataFrame([("r", "c", 1)], "run_id string, claim string, seq int")
    for run in ("r", "r", "s"):  # a repeated run adds nothing
        ledger.append_ledger(rows, str(tmp_path / "ledger"), run)
    assert ledger.read_ledger(spark, str(tmp_path / "ledger"), "r", "c").count() == 1
    assert ledger.read_ledger(spark, str(tmp_path / "ledger"), claim="c").count() == 2


def test_answers(spark):
    schema = "claims array<struct<gene_symbol:string,confidence:double>>"
    rows = [('{"claims":[{"gene_symbol":"A","confidence":0.5}]}',), ('{"claims":[{"gene_symbol":"A","confidence":1.5}]}',), ('{"claims":[{"gene_symbol":"A","confidence":0.5},{"gene_symbol":"a","confidence":0.1}]}',), ("no",)]
    got = [r["status"] for r in forecast.valid_answers(spark.createDataFrame(rows, "answer string"), schema, []).collect()]
    assert got == ["ok", "confidence outside 0..1", "two answers for a gene", "not the schema"]


def test_trap_builders(spark):
    a = spark.createDataFrame([("A", 1e-9, "s", "r1"), ("B", 1e-9, "s", "r2"), ("C", 0.5, "s", "r3")], "entity string, p double, accession string, record string")
    assert [r["entity"] for r in traps.association_traps(a, spark.createDataFrame([("B",)], "entity string")).collect()] == ["A"]
    effects = spark.range(200).select(F.lit("A").alias("entity"), F.lit(-1.2).alias("effect"))
    assert traps.essential_traps(effects).first()["essential_lines"] == 200


def test_phenotypes_by_readout_and_exact_label(spark):
    cases = [("HbF by F-cell and HPLC", "x", "", "f_cell"), ("fetal hemoglobin antibody", "x", "", "hbf_protein"), ("HBG2 RNA-Seq", "x", "", "hbg_mrna"), ("HbF", "viability", "", "hbg_reporter"), ("hbfoo protein", "Viability [a]", "", "cell_fitness"), ("", "essential growth", "", None), ("", "differentiation", "CD34+", "erythroid_differentiation"), ("CD34", "differentiation", "lung", None), ("", None, None, None)]
    rows = spark.createDataFrame([c[:3] for c in cases], "body string, label string, context string")
    assert [r[0] for r in rows.select(rules.classify_phenotype(F.col("body"), F.col("label"), F.col("context"))).collect()] == [c[3] for c in cases]


def test_cell_systems(spark):
    cases = [("CVCL_VI06", "Mus musculus", "Cancer cell line", "human_erythroid_progenitor_line"), ("x", "Mus musculus (Mouse)", "", "mouse_line"), ("x", "Danio rerio", "", "non_human_other"), ("x", "Homo sapiens", "Cancer cell line", "human_cancer_line"), ("x", "", "Transformed cell line", "human_immortalized_line"), ("x", None, "Embryonic stem cell", "primary_human_hspc"), ("x", "Homo sapiens", "Finite cell line", "primary_human_hspc"), ("x", None, None, "human_immortalized_line")]
    rows = spark.createDataFrame([c[:3] for c in cases], "a string, s string, c string")
    assert [r[0] for r in rows.select(rules.cell_system(F.col("a"), F.col("s"), F.col("c"), policy.KNOWN_SYSTEMS)).collect()] == [c[3] for c in cases]


def test_scan_at_any_depth(spark):
    long = "y" * 601
    attrs = [json.dumps({"a": [{"b": {"Body-Text": None}}]}), json.dumps({"title": long, "caveat": long}), json.dumps({"xs": [long]}), "no json", None]
    rows = spark.createDataFrame([(a, {"Snippet": "s", "k": long}, [("p", long)]) for a in attrs], "attrs string, m map<string,string>, boxes array<struct<pdf:string,note:string>>")
    got = [r["findings"] for r in redistribution.scan(rows, ("attrs",)).collect()]
    common = ["m.Snippet: forbidden field", "m.k: long text", "boxes[].pdf: forbidden field"]
    assert [sorted(set(g) - set(common)) for g in got] == [["attrs.a[0].b.Body-Text: forbidden field"], ["attrs.title: long text"], [], ["attrs: not JSON"], []]
    assert all(set(common) <= set(g) for g in got)


def test_contamination_is_told_by_kind(spark):
    rows = spark.createDataFrame([("c", "postdates_cutoff", True, False), ("c", "postdates_cutoff", True, True), ("c", "association", True, True), ("c", "essential", True, False), ("c", "association", False, False)], "cutoff string, kind string, passed boolean, vacuous boolean")
    assert grade.trap_rollup(rows, ["cutoff"]).first().asDict() == {"cutoff": "c", "traps": 5, "passed": 4, "vacuous": 2, "meaningful": 2, "judgement_total": 3, "judgement": 1, "contamination_total": 2, "contamination": 2}


def test_ranks_over_range_parts(spark):
    items = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 11).alias("x"), "id")
    got = {(r["k"], r["id"]): r["rank"] for r in forecast.ranked_by(items.repartition(7), ["k"], [F.desc("x"), F.col("id")], "rank").collect()}
    for k in range(3):
        order = sorted((i for i in range(500) if i % 3 == k), key=lambda i: (-(i * 37 % 11), i))
        assert [got[k, i] for i in order] == list(range(1, len(order) + 1))


def test_edges_visible_from_their_latest_end(toy):
    nodes, edges = toy
    cuts = ["2014-01-01", "2018-06-01", "2018-06-02"]
    got = sorted((str(r["cutoff"]), r["id"]) for r in slices.visible_edges(nodes, edges, cuts).collect())
    want = sorted((str(r["cutoff"]), r["id"]) for r in slices.drop_dangling(slices.asof(nodes, cuts), slices.asof(edges, cuts)).collect())
    assert got == want


def test_phrases_must_stand_side_by_side(spark):
    titles = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta alpha, Alpha-Beta"), (3, "alpha x beta"), (4, None)], "id long, title string")
    asked = spark.createDataFrame([("q", "Alpha beta"), ("none", "!!")], "query string, phrase string")
    assert [(r["query"], r["id"]) for r in retrieval.bm25(titles, asked).orderBy("id").collect()] == [("q", 1), ("q", 2)]
