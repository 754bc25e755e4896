"""Readers of the raw sources, each with an explicit schema (S01-S13), and writers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import archives, members
from tidemark.sources.documents import read_elements
from tidemark.sources.folders import scratch_folder  # noqa: F401

PROVENANCE = "source_id string, license string, time_scope string, effective_date date, accession string, pmid string, publication_date date, publication_date_online date, publication_date_issue date, ingest_hash string"
NODE = f"id string, type string, label string, attrs string, {PROVENANCE}"
EDGE = f"id string, type string, src string, dst string, attrs string, {PROVENANCE}"
EXCLUSION = "source string, source_id string, reason string, detail string"

GENES = "hgnc_id string, symbol string, name string, locus_group string, locus_type string, status string, date_approved_reserved string, date_symbol_changed string, date_name_changed string, alias_symbol string, prev_symbol string, ensembl_gene_id string, entrez_id string, uniprot_ids string, location string, gene_group string, gene_group_id string, enzyme_id string"
LITERATURE = "id string, pmid string, doi string, title string, journalTitle string, authorString string, pubType string, isOpenAccess string, license string, citedByCount long, firstPublicationDate string, print_publication_date string, matched_genes array<string>, matched_tiers array<string>"
SCREENS = "screen_id long, http_status int, banner string, pmid string, title string, phenotype string, screen_rationale string, notes string, condition string, cell_line_name string, cell_type_name string, cellosaurus_id string, type string, methodology string, format string, enzyme string, library_name string, library_source string, analysis_method string, significance string, experimental_setup string, duration string, number_of_hits_n long, full_dataset_size_n long"
ASSOCIATIONS = "studyAccession string, pvalue double, pvalueMantissa double, pvalueExponent double, betaNum double, betaUnit string, betaDirection string, orPerCopyNum double, efoTraits array<string>, loci array<struct<reportedGenes:array<string>,riskAlleles:array<string>>>, study struct<pubmedId:string,publicationDate:string,diseaseTrait:string,ancestries:array<struct<type:string,n:long,groups:array<string>>>>"
ESSENTIALITY = "map<string,struct<id:string,depMapEssentiality:array<struct<tissueName:string,screens:array<struct<depmapId:string,cellLineName:string,diseaseFromSource:string,geneEffect:double,expression:double>>>>>>"
EVIDENCE = "map<string,map<string,struct<name:string,evidences:struct<rows:array<struct<id:string,score:double,datatypeId:string,datasourceId:string,literature:array<string>,publicationDate:string,publicationYear:int>>>>>>"
TRIALS = "protocolSection struct<identificationModule:struct<nctId:string,briefTitle:string,officialTitle:string>,statusModule:struct<overallStatus:string,studyFirstPostDateStruct:struct<date:string>,startDateStruct:struct<date:string>>,designModule:struct<phases:array<string>,studyType:string,enrollmentInfo:struct<count:long>>,armsInterventionsModule:struct<interventions:array<struct<type:string,name:string>>>,sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string,class:string>>,conditionsModule:struct<conditions:array<string>>>"
HITS = "IDENTIFIER_NUMBER string, IDENTIFIER_ID string, IDENTIFIER_TYPE string, OFFICIAL_SYMBOL string, ALIASES string, `SCORE.1` string, `SCORE.2` string, `SCORE.3` string, HIT string"
CELLS = "map<string,struct<name:string,category:string,species:array<string>,diseases:array<struct<term:string>>>>"


def read_snapshot(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and exclusions from gzipped JSON lines. Files with an index of their members are read by many tasks each;
    a gzip file without one is one split, so its rows are dealt out after it."""

    def read(name: str, schema: str) -> DataFrame:
        path = f"{folder}/{name}.jsonl.gz"
        if members.has_index(spark, path):
            return members.read_lines(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*")
        return spark.read.schema(schema).json(path).repartition(spark.sparkContext.defaultParallelism)

    return read("nodes", NODE), read("edges", EDGE), read("exclusions", EXCLUSION)


def write_snapshot(tables: dict[str, DataFrame], folder: str, scan) -> dict[str, int]:
    """Rows without a finding of ``scan`` (a function that adds the array column findings) as Parquet and as JSON lines in
    gzip members with an index; gives row counts."""
    counts = {}
    for name, table in tables.items():
        clean = scan(table).filter(F.size("findings") == 0).drop("findings")
        clean.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        kept = table.sparkSession.read.parquet(f"{folder}/{name}.parquet")
        index = members.write_lines(kept.select(F.to_json(F.struct("*")).alias("value")), f"{folder}/{name}.jsonl.gz")
        counts[name] = index.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    return counts


def verify_snapshot(spark: SparkSession, folder: str, manifest: DataFrame, name: Column | None = None) -> DataFrame:
    """Files of the manifest (path, sha256) that are missing or differ, and which. ``name``: how a file is called there, from
    its full ``path`` (the last part by default). Files of any length: large ones are streamed, not held."""
    files = members.digests(spark, folder)
    if not manifest.filter(F.col("sha256") == members.EMPTY).isEmpty():
        files = files.union(members.empty_files(spark, folder))
    have = files.select((F.substring_index("path", "/", -1) if name is None else name).alias("path"), F.col("sha256").alias("found"))
    out = manifest.join(have, "path", "left")
    return out.withColumn("problem", F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "differs")).filter("problem IS NOT NULL").select("path", "problem")


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """Genes with lists split, and reject_reason for rows without an approval date; rows without id or symbol are dropped."""
    raw = spark.read.schema(GENES).csv(path, sep="\t", header=True).filter("hgnc_id IS NOT NULL AND symbol IS NOT NULL")
    listed = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, r"\|"))
    approved = F.when(F.col("date_approved_reserved").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("date_approved_reserved"))
    return raw.select(F.col("hgnc_id").alias("id"), "symbol", "name", listed("alias_symbol").alias("aliases"), listed("prev_symbol").alias("previous"), F.col("entrez_id").alias("entrez"), F.col("ensembl_gene_id").alias("ensembl"), "locus_type", listed("gene_group").alias("groups"), approved.alias("approved"), F.when(approved.isNull(), "no approval date").alias("reject_reason"))


def read_literature(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON arrays of bibliographic records, in the order of the files (file_order) and of their rows (position)."""
    out, kind = None, T.StructType.fromDDL(LITERATURE)
    for i, path in enumerate(paths):
        rows = read_elements(spark, path)
        before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        starts = rows.groupBy("file").agg(F.count("*").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row per file
        rows = rows.join(starts, "file").withColumn("position", F.col("start") + F.col("position"))
        rows = rows.select("position", F.from_json("text", kind).alias("r")).select("r.*", F.lit(i).alias("file_order"), "position")
        out = rows if out is None else out.unionByName(rows)
    return out


def read_screens(spark: SparkSession, glob: str) -> DataFrame:
    """Screens that were fetched."""
    return spark.read.schema(SCREENS).option("multiLine", True).json(glob).filter("http_status = 200")


def hit_files(spark: SparkSession, glob: str, number: str = r"SCREEN_(\d+)-", named_by: str = "_metadata.file_name") -> DataFrame:
    """The first file of each screen by name: screen_id, path, bytes. From a listing alone; no file is opened. Files whose name
    has no screen's number belong to none."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob)
    named = listed.select(F.regexp_extract(named_by, number, 1).try_cast("long").alias("screen_id"), F.col(named_by).alias("name"), "path", F.col("length").alias("bytes"))
    return named.filter("screen_id IS NOT NULL").groupBy("screen_id").agg(F.min_by(F.struct("path", "bytes"), F.struct("name", "path")).alias("f")).select("screen_id", "f.*")


def read_hits(spark: SparkSession, glob: str, number: str = r"SCREEN_(\d+)-", named_by: str = "_metadata.file_name") -> DataFrame:
    """Hit tables, the screen's id from the file's name (or path), the first file of each screen.

    The files are chosen from their names (``hit_files``) before any is read, so others cost nothing and none is read twice;
    Spark packs small ones into shared splits. The driver holds the chosen paths, one per screen, as any scan of them would.
    """
    chosen = sorted(r["path"] for r in hit_files(spark, glob, number, named_by).select("path").collect())
    literal = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in chosen]  # a path's own brackets and stars are no pattern
    reader = spark.read.schema(HITS).option("recursiveFileLookup", "true")
    raw = reader.csv(literal, sep="\t", comment="#", enforceSchema=True) if chosen else spark.createDataFrame([], HITS)
    return _hit_rows(raw, F.regexp_extract(F.col(named_by), number, 1).cast("long") if chosen else F.lit(None).cast("long"))


def _hit_rows(raw: DataFrame, screen: Column) -> DataFrame:
    return raw.select(screen.alias("screen_id"), "IDENTIFIER_ID", "IDENTIFIER_TYPE", "OFFICIAL_SYMBOL", F.split("ALIASES", r"\|").alias("aliases"), F.col("`SCORE.1`").alias("score_1"), F.col("`SCORE.2`").alias("score_2"), F.col("`SCORE.3`").alias("score_3"), (F.upper("HIT") == "YES").alias("hit"))


def read_hit_archives(spark: SparkSession, folder: str, number: str = r"SCREEN_(\d+)-") -> DataFrame:
    """Hit tables in the tar archives of their release, the screen's id from the table's name, the first table of each screen
    by name; of several of one name in an archive the last, as unpacking would leave it. The choice is made from the archives'
    headers, among the executors: the driver holds no path of a table."""
    listed = archives.tables(spark, folder).withColumn("name", F.substring_index("name", "/", -1))
    named = listed.withColumn("screen_id", F.regexp_extract("name", number, 1).try_cast("long")).filter("screen_id IS NOT NULL")
    chosen = named.groupBy("screen_id").agg(F.min_by(F.struct("file", "offset", "length"), F.struct("name", "file", -F.col("offset"))).alias("t")).select("screen_id", "t.*")
    lines = archives.read_lines(chosen, "screen_id").filter(~F.startswith("line", F.lit("#")))
    return _hit_rows(lines.select("screen_id", F.from_csv("line", F.lit(HITS), {"sep": "\t"}).alias("r")).select("screen_id", "r.*"), F.col("screen_id"))


def read_associations(spark: SparkSession, path: str) -> DataFrame:
    """One row per association of a file's JSON array, with its place in it and its distinct, sorted reported genes."""
    kind = T.StructType.fromDDL(ASSOCIATIONS)
    rows = read_elements(spark, path).select(F.col("position").cast("int").alias("position"), F.from_json("text", kind).alias("a")).select("position", "a.*")
    listed = lambda name: F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("loci", lambda x: F.coalesce(x[name], F.array().cast("array<string>")))), lambda g: g.isNotNull())))
    return rows.withColumns({"genes": listed("reportedGenes"), "risk_alleles": listed("riskAlleles")})


def _exploded_map(spark: SparkSession, path: str, kind: str, key: str, value: str) -> DataFrame:
    entries = read_elements(spark, path).select(F.concat(F.lit("{"), "text", F.lit("}")).alias("entry"))
    return entries.select(F.explode(F.from_json("entry", kind)).alias(key, value))


def read_essentiality(spark: SparkSession, path: str) -> DataFrame:
    """Symbol, line and gene effect."""
    rows = _exploded_map(spark, path, ESSENTIALITY, "symbol", "target").select("symbol", F.explode("target.depMapEssentiality").alias("tissue"))
    return rows.select("symbol", "tissue.tissueName", F.explode("tissue.screens").alias("s")).select("symbol", F.col("tissueName").alias("tissue"), "s.*")


def read_target_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Symbol, trait and evidence rows."""
    rows = _exploded_map(spark, path, EVIDENCE, "symbol", "traits").select("symbol", F.explode("traits").alias("trait", "t"))
    return rows.select("symbol", "trait", F.col("t.name").alias("trait_name"), F.explode("t.evidences.rows").alias("e")).select("symbol", "trait", "trait_name", "e.*")


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Trials, flat."""
    p = "protocolSection"
    return spark.read.schema(TRIALS).json(path).select(
        F.col(f"{p}.identificationModule.nctId").alias("nct_id"),
        F.concat_ws(" ", f"{p}.identificationModule.briefTitle", f"{p}.identificationModule.officialTitle").alias("title"),
        F.col(f"{p}.statusModule.overallStatus").alias("status"),
        F.col(f"{p}.statusModule.studyFirstPostDateStruct.date").alias("posted"),
        F.col(f"{p}.statusModule.startDateStruct.date").alias("started"),
        F.col(f"{p}.designModule.phases").alias("phases"),
        F.col(f"{p}.designModule.enrollmentInfo.count").alias("enrolled"),
        F.transform(f"{p}.armsInterventionsModule.interventions", lambda x: x["name"]).alias("interventions"),
        F.col(f"{p}.conditionsModule.conditions").alias("conditions"),
    )


def read_cell_lines(spark: SparkSession, path: str) -> DataFrame:
    """Cell lines by accession."""
    rows = _exploded_map(spark, path, CELLS, "accession", "c")
    return rows.select("accession", "c.name", "c.category", F.array_join("c.species", "; ").alias("species"), F.transform("c.diseases", lambda d: d["term"]).alias("diseases"))


def load_rulebook(rulebook: DataFrame, corrections: DataFrame) -> DataFrame:
    """The answer key with corrections: their ``established`` where given, always their record; new symbols come in."""
    fix = corrections.select("symbol", F.col("established").alias("fix_established"), F.col("record").alias("fix_record"), F.lit(True).alias("adjudicated"))
    both = rulebook.join(fix, "symbol", "full")
    done = F.coalesce("adjudicated", F.lit(False))
    return both.select("symbol", F.coalesce("fix_established", "established").alias("established"), F.when(done, F.col("fix_record")).otherwise(F.col("record")).alias("record"), done.alias("adjudicated"))


def write_results(results: DataFrame, path: str) -> None:
    """One partition per cutoff and ablation."""
    results.write.mode("overwrite").partitionBy("cutoff", "ablation").parquet(path)
