"""Findings of the fourth round: hit tables (F2), which once were as many files as screens."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.plans import driver, files
from tidemark.sources import archives, readers

SMALLEST = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pack(path, tables):
    with tarfile.open(path, "w") as tar:
        for name, data in tables:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def test_hit_tables_are_few_files_whatever_the_screens(spark, monkeypatch):  # F2, F1
    monkeypatch.setattr(archives, "ARCHIVE", 4096, raising=False)
    path = files.hit_tables(spark, SMALLEST)
    lines = driver.read(spark, SMALLEST, "lineitem").filter("l_suppkey % 9 <> 0")
    want = {r["l_suppkey"]: r["count"] for r in lines.groupBy("l_suppkey").count().collect()}
    opened = [r["path"].removeprefix("file:") for r in spark.read.format("binaryFile").load(path).collect()]
    tables = [(m.name, tar.extractfile(m).read()) for p in opened for tar in [tarfile.open(p)] for m in tar]
    assert {int(n.split("SCREEN_")[1].split("-")[0]): t.count(b"\n") - 1 for n, t in tables} == want and len(tables) == len(want)
    assert all(t.startswith(b"#IDENTIFIER_NUMBER\t") for _, t in tables) and len(opened) > 4
    monkeypatch.setattr(archives, "ARCHIVE", 64 << 20)
    few = spark.read.format("binaryFile").load(files.hit_tables(spark, SMALLEST))
    assert few.count() <= int(spark.conf.get("spark.sql.shuffle.partitions")) < len(want)
    assert {r["screen_id"]: r["count"] for r in files.read_hits(spark, SMALLEST).groupBy("screen_id").count().collect()} == want


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_a_table_is_read_alike_from_an_archive_and_from_its_own_file(spark, tmp_path, monkeypatch, size):  # F2
    monkeypatch.setattr(archives, "RANGE", size)
    row = "1\tE{0}\tENTREZ_GENE\tP{0}é\tx|y\t{0}.5\t\t\tYES"
    tables = {
        "BIOGRID-ORCS-SCREEN_7-2.screen.tab.txt": "#A\tB\n" + "\n".join(row.format(i) for i in range(9)) + "\n\n  \n#late\n" + row.format(10),
        "BIOGRID-ORCS-SCREEN_7-1.screen.tab.txt": "#A\tB\r\n" + row.format(1) + '\r\n1\t"E\t2"\tOTHER\t"a""b"\t\t-\n2\tE\n',
        "BIOGRID-ORCS-SCREEN_8-1.screen.tab.txt": "#A\tB\n",
        "BIOGRID-ORCS-SCREEN_9-1.screen.tab.txt": "",
        "BIOGRID-ORCS-SCREEN_10-1.screen.tab.txt": row.format(3) + "\textra\n" * 2,
        "readme.txt": row.format(99) + "\n",
    }
    (tmp_path / "own").mkdir()
    (tmp_path / "packed").mkdir()
    for name, text in tables.items():
        (tmp_path / "own" / name).write_bytes(text.encode())
    stale = ("BIOGRID-ORCS-SCREEN_10-1.screen.tab.txt", row.format(77).encode())  # written again further on
    pack(tmp_path / "packed" / "a.tar", [stale, *((f"release/{n}", t.encode()) for n, t in list(tables.items())[1:])])
    pack(tmp_path / "packed" / "b.tar", [(n, t.encode()) for n, t in list(tables.items())[:2]])  # a table twice is one
    pack(tmp_path / "packed" / "c.tar", [])
    (tmp_path / "packed" / "_part.tar").write_bytes(b"not whole yet")
    got = sorted(map(str, readers.read_hit_archives(spark, str(tmp_path / "packed")).collect()))
    assert got == sorted(map(str, readers.read_hits(spark, str(tmp_path / "own")).collect())) and len(got) == 5
    assert sorted(r["n"] for r in readers.read_hit_archives(spark, str(tmp_path / "packed")).groupBy("screen_id").agg(F.count("*").alias("n")).collect()) == [2, 3]


def test_a_broken_archive_is_an_error(spark, tmp_path):  # F2
    pack(tmp_path / "a.tar", [("SCREEN_1-x", b"1\tE\n" * 5000)])
    whole = (tmp_path / "a.tar").read_bytes()
    (tmp_path / "a.tar").write_bytes(whole[:9000])
    with pytest.raises(Exception, match="end of data|ends within"):
        readers.read_hit_archives(spark, str(tmp_path)).collect()


def test_hits_without_an_identifier_stay_apart_and_edges_take_one_reading(spark):  # F2
    entities = spark.createDataFrame([(1, "P1", "E1"), (2, "P2", "E2"), (3, "E9", "E3")], "id long, symbol string, entrez string").selectExpr("*", "cast(null AS string) AS ensembl", "array('a') AS aliases", "array(symbol || 'old') AS previous")
    hits = spark.createDataFrame([(5, "E2", "ENTREZ_GENE", " P1", "1.5"), (5, "E2", "OTHER", "P1", "1"), (5, None, "ENTREZ_GENE", "E2", "-"), (5, "nope", "ENTREZ_GENE", "p2OLD", "2"), (5, "E9", "ENTREZ_GENE", "none", "3"), (5, "E1", "OTHER", "none", "3"), (6, "E1", "ENTREZ_GENE", "P1", "1"), (5, "E1", "ENTREZ_GENE", "unasked", "1")], "screen_id long, IDENTIFIER_ID string, IDENTIFIER_TYPE string, OFFICIAL_SYMBOL string, score_1 string").withColumn("hit", F.lit(True))
    scope = hits.select(F.upper(F.trim("OFFICIAL_SYMBOL")).alias("symbol")).filter("symbol <> 'UNASKED'").distinct()
    screens = spark.createDataFrame([(5, "15", "growth"), (6, "16", "nothing")], "screen_id long, pmid string, phenotype string").selectExpr("*", *[f"'' AS {c}" for c in "notes screen_rationale title condition cell_line_name cell_type_name type methodology".split()], "'CV' AS cellosaurus_id")
    dates = spark.createDataFrame([("15",), ("16",)], "pmid string").withColumn("date", F.lit("2012-01-01").cast("date"))
    tagged, rows = ingest.screen_rows(screens, hits, scope, entities, spark.createDataFrame([("CV", "s")], "accession string, system string"), dates)
    assert {r["screen_id"]: r["reject_reason"] for r in tagged.collect()} == {5: None, 6: "out_of_scope"}
    got = sorted((r["gene"] or 0, r["source_id"], r["reject_reason"] or "") for r in rows.collect())
    assert got == [(0, "screen:5:none", "unresolved_symbol"), (1, "screen:5:1", ""), (2, "screen:5:2", ""), (2, "screen:5:2", ""), (2, "screen:5:2", "no_numeric_value"), (3, "screen:5:3", "")]
    edges = ingest.screen_edges(rows)
    assert "Union" not in plan(edges)
    assert {r["type"]: r["count"] for r in edges.groupBy("type").count().collect()} == {"SCREEN_TESTED": 5, "MEASURED_IN": 4, "PERTURBS": 4, "REPORTS": 4}
    assert ingest.screen_edges(rows.withColumn("pmid", F.lit(None).cast("string"))).filter("type = 'REPORTS'").count() == 0
