"""From raw records to dated rows, one tagged table per source.

Every function gives rows with ``reject_reason``, null where a row is accepted; ``split`` parts them in one reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import policy
from tidemark.functions import rules, scalars, text
from tidemark.operators import resolve

NODE_TYPES = ("Gene", "Perturbation", "Screen", "CellContext", "Phenotype", "Measurement", "Publication", "Claim", "Modality", "Trial")
EDGE_TYPES = ("SCREEN_TESTED", "PERTURBS", "MEASURED_IN", "REPORTS", "SUPPORTS", "CONTRADICTS", "SUPERSEDES", "IMPLIES_MODALITY", "ACTS_THROUGH")
SCOPES = ("DATED", "REFERENCE", "VOCABULARY")

# Phenotype vocabulary with family and directness.
PHENOTYPES = (("hbf_protein", "HBF", "direct_protein"), ("f_cell", "HBF", "direct_protein"), ("hbg_mrna", "HBF", "transcript"), ("hbg_reporter", "HBF", "proxy"), ("erythroid_differentiation", "ERYTHROID", "proxy"), ("cell_fitness", "FITNESS", "proxy"), ("globin_switching", "HBF", "transcript"))


def split(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and exclusions (source, source_id, reason)."""
    bad = tagged.filter("reject_reason IS NOT NULL").select("source", "source_id", F.col("reject_reason").alias("reason"))
    return tagged.filter("reject_reason IS NULL").drop("reject_reason"), bad


def validate(rows: DataFrame, types: tuple[str, ...] = NODE_TYPES, required: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows with problems, the array of every failed condition; ``required``: attributes per type, of the JSON text attrs."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    checks = [F.when(blank(c), f"{c} is empty") for c in ("id", "label", "source_id", "license")]
    checks += [F.when(~rules.in_enum(F.col("type"), *types), "unknown type"), F.when(~rules.in_enum(F.col("time_scope"), *SCOPES), "unknown scope")]
    checks += [F.when(F.col("pmid").isNotNull() & ~F.trim("pmid").rlike(r"^\d+$"), "pmid is no number"), F.when(scalars.effective_date(F.col("time_scope"), F.col("effective_date"), F.col("publication_date")).isNull(), "no effective date")]
    for kind, names in (required or {}).items():
        checks += [F.when((F.col("type") == kind) & F.get_json_object("attrs", f"$.{n}").isNull(), f"{kind} lacks {n}") for n in names]
    return rows.withColumn("problems", F.array_compact(F.array(*checks)))


def first_trait(traits: Column, fallback: Column, table: dict[str, str]) -> Column:
    """P10: the first trait that the table knows, in array order, then the fallback."""
    every = F.array_append(F.coalesce(traits, F.array().cast("array<string>")), fallback)
    return F.get(F.filter(F.transform(every, lambda t: rules.lookup(table, F.lower(t))), lambda x: x.isNotNull()), F.lit(0))


def association_rows(associations: DataFrame, traits: dict[str, str]) -> DataFrame:
    """One measurement per association and distinct reported gene, its place in the id."""
    p = scalars.association_p(F.col("pvalue"), F.col("pvalueMantissa"), F.col("pvalueExponent"))
    sample = F.aggregate(F.filter("study.ancestries", lambda a: a["type"] == "initial"), F.lit(0).cast("long"), lambda n, a: n + F.coalesce(a["n"], F.lit(0)))
    ancestries = F.array_sort(F.array_distinct(F.flatten(F.transform("study.ancestries", lambda a: F.coalesce(a["groups"], F.array().cast("array<string>"))))))
    rows = associations.withColumns({"p": p, "phenotype": first_trait(F.col("efoTraits"), F.col("study.diseaseTrait"), traits), "date": scalars.day(F.col("study.publicationDate")), "sample_size": F.coalesce(sample, F.lit(0)), "ancestries": F.coalesce(ancestries, F.array().cast("array<string>"))})
    reason = F.when(F.col("phenotype").isNull(), "out_of_scope").when(F.col("p").isNull(), "malformed_record").when(F.col("date").isNull(), "unresolvable_date").when(F.coalesce(F.size("genes"), F.lit(0)) < 1, "unresolved_gene")
    rows = rows.select(F.lit("associations").alias("source"), F.col("studyAccession").alias("source_id"), F.col("study.pubmedId").alias("pmid"), "p", "phenotype", "date", "sample_size", "ancestries", "risk_alleles", "position", F.explode_outer("genes").alias("symbol"), reason.alias("reject_reason"))
    return rows.withColumns({"id": F.concat_ws(":", F.lit("meas:gwas"), "source_id", "symbol", F.col("position").cast("string")), "value": scalars.p_strength(F.col("p")), "significant": scalars.significant(F.col("p")), "assay": F.lit("gwas_association"), "system": F.lit("human_population"), "perturbation": F.lit("genetic_variant"), "author_reported": F.lit(True)})


def evidence_rows(evidence: DataFrame, dates: DataFrame, release: str) -> DataFrame:
    """Target evidence, dated by its publication, then its own day; a year alone is excluded, nothing means the release."""
    pmid = F.get(F.filter("literature", lambda x: x.rlike(r"^[0-9]+$")), F.lit(0))
    own = scalars.day(F.col("publicationDate"))
    known = dates.select(F.col("pmid").alias("d_pmid"), F.col("date").alias("resolved")).hint("merge")  # as many as publications: no broadcast
    rows = evidence.withColumn("pmid", pmid).join(known, (F.coalesce("pmid", "id") == F.col("d_pmid")) & F.col("pmid").isNotNull(), "left")  # nulls in one task otherwise
    only_year = F.col("resolved").isNull() & own.isNull() & (F.col("publicationYear").isNotNull() | F.col("publicationDate").isNotNull())
    return rows.select(F.lit("evidence").alias("source"), F.col("id").alias("source_id"), "symbol", "trait", "pmid", "score", F.coalesce("resolved", own, F.when(~only_year, F.lit(release).cast("date"))).alias("date"), F.concat(F.lit("opentargets_"), "datatypeId").alias("assay"), F.when(only_year, "unresolvable_date").alias("reject_reason"))


def essentiality_rows(lines: DataFrame, release: str) -> DataFrame:
    """One measurement per gene and line."""
    effect = F.when(~F.isnan("geneEffect") & (F.abs("geneEffect") < float("inf")), F.col("geneEffect"))
    return lines.select(F.lit("essentiality").alias("source"), F.concat_ws(":", "symbol", "depmapId").alias("source_id"), "symbol", F.col("depmapId").alias("line"), effect.alias("effect"), (effect <= policy.ESSENTIAL_EFFECT).alias("hit"), F.lit(release).cast("date").alias("date"), F.lit("depmap_gene_effect").alias("assay"), F.when(effect.isNull(), "malformed_record").alias("reject_reason"))


def trial_rows(trials: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Dated by the first day-precision date of posted and started; the route from ordered patterns."""
    date = F.coalesce(scalars.day(F.col("posted")), scalars.day(F.col("started")))
    blob = F.concat_ws(" ", "title", "interventions")
    return trials.select(F.lit("trials").alias("source"), F.col("nct_id").alias("source_id"), "title", "status", "phases", "enrolled", date.alias("date"), rules.first_contained(blob, patterns).alias("modality"), F.when(date.isNull(), "unresolvable_date").alias("reject_reason"))


def gene_rows(genes: DataFrame, scope: list[str]) -> DataFrame:
    """The whole universe of genes, dated by approval, with in_scope."""
    inside = F.upper("symbol").isin(*[s.upper() for s in scope]) if scope else F.lit(False)
    return genes.select(F.lit("genes").alias("source"), F.col("id").alias("source_id"), F.concat(F.lit("gene:"), "id").alias("id"), "symbol", "aliases", "previous", F.col("approved").alias("effective_date"), F.lit("REFERENCE").alias("time_scope"), inside.alias("in_scope"), "reject_reason")


def vocabulary(spark) -> DataFrame:
    """Phenotypes, routes and perturbations as rows as old as the calendar."""
    rows = [(f"pheno:{k}", "Phenotype", k, family, directness, None) for k, family, directness in PHENOTYPES]
    rows += [(f"modality:{k}", "Modality", k, None, None, w) for k, w in policy.ROUTE_WEIGHTS.items()]
    rows += [(f"perturbation:{k}", "Perturbation", k, None, None, w) for k, w in policy.PERTURBATION_WEIGHTS.items()]
    out = spark.createDataFrame(rows, "id string, type string, label string, family string, directness string, weight double")
    return out.withColumns({"time_scope": F.lit("VOCABULARY"), "effective_date": F.lit("0001-01-01").cast("date")})


def publication_rows(literature: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """The first dated sighting of each pmid, with the genes its title names (of those a search found it for).

    ``terms``: usable terms of each symbol. A title is matched in its own row, before any shuffle, so texts move only if they are
    asked for; rows without a pmid, of which all are kept, are spread over the tasks.
    """
    date = scalars.first_day(F.col("firstPublicationDate"), F.col("print_publication_date"))
    rows = literature.withColumn("d", date).withColumn("reject_reason", F.when(F.col("pmid").isNull(), "malformed_record").when(F.col("d.date").isNull(), "unresolvable_date"))
    patterns = rows.sparkSession.createDataFrame([(k, text.names_pattern(w)) for k, w in terms.items()] or [("", "")], "symbol string, pattern string").filter("pattern <> ''")
    table = patterns.agg(F.map_from_entries(F.collect_list(F.struct("symbol", "pattern"))).alias("patterns"))  # one row, as data: the plan doesn't grow with the symbols
    named = F.filter("matched_genes", lambda s: F.rlike(text.fold_greek(F.col("title")), F.try_element_at("patterns", s)))
    genes = F.when(F.col("pmid").isNotNull(), F.array_sort(F.array_distinct(named)))
    rows = rows.crossJoin(F.broadcast(table)).withColumn("genes", genes).drop("patterns")
    alone = F.when(F.col("pmid").isNull(), F.struct("file_order", "position"))
    order = Window.partitionBy("pmid", alone).orderBy(F.col("reject_reason").isNotNull(), "file_order", "position")
    out = rows.withColumn("place", F.row_number().over(order)).filter((F.col("place") == 1) | F.col("pmid").isNull())
    return out.select(F.lit("literature").alias("source"), F.coalesce("pmid", "id").alias("source_id"), "pmid", "title", F.col("d.date").alias("date"), F.col("d.rule").alias("date_rule"), F.coalesce("genes", F.array().cast("array<string>")).alias("genes"), F.col("matched_genes").alias("searched_genes"), F.col("matched_tiers").alias("tiers"), "reject_reason")


def screen_rows(screens: DataFrame, hits: DataFrame, genes: DataFrame, entities: DataFrame, cells: DataFrame, dates: DataFrame, perturbations: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Screen metadata and hit tables as tagged rows of screens, and of tested genes (also those that didn't score).

    Screens: unresolvable_date, out_of_scope, unresolved_cell_line, then malformed_record (a good screen without a hit table).
    Genes of a good screen: unresolved_symbol; then tested, and no_numeric_value where the score is no number (no measurement
    is made then). ``genes``: symbols in scope, upper case; hits of others are dropped before any other join. ``entities``: as
    ``resolve.resolve`` takes them. ``cells``: accession, system. ``dates``: pmid, date.
    """
    meta = resolve.attach_dates(screens.withColumns({"pmid": F.nullif(F.trim("pmid"), F.lit("")), "own": F.lit(None).cast("date")}), dates, "own").withColumnsRenamed({"cellosaurus_id": "accession", "cell_line_name": "cell_name", "cell_type_name": "cell_type"})
    meta = meta.withColumns({"pheno": rules.classify_phenotype(F.concat_ws(" ", "phenotype", "notes", "screen_rationale", "title", "condition"), F.col("phenotype"), F.concat_ws(" ", "cell_name", "cell_type", "title", "notes")), "perturbation": rules.perturbation_class(F.col("type"), F.col("methodology"), perturbations or policy.PERTURBATION_CLASSES)})
    meta = resolve.resolve_cells(meta, cells, policy.PRIMARY_TERMS, policy.MOUSE_TERMS)
    listed = hits.select("screen_id").distinct().withColumn("has_hits", F.lit(True))
    meta = meta.join(listed, "screen_id", "left")
    reason = F.when(F.col("date").isNull(), "unresolvable_date").when(F.col("pheno").isNull(), "out_of_scope").when(F.col("system").isNull(), "unresolved_cell_line").when(F.col("has_hits").isNull(), "malformed_record")
    tagged = meta.select(F.lit("screens").alias("source"), F.concat(F.lit("screen:"), F.col("screen_id").cast("string")).alias("source_id"), "screen_id", "pmid", "date", "pheno", "system", "accession", "perturbation", reason.alias("reject_reason"))
    good = tagged.filter("reject_reason IS NULL").select("screen_id", "pmid", "date", F.col("pheno").alias("phenotype"), "system", "accession", "perturbation")
    # An identifier of the entrez kind goes before the symbol.
    named = hits.withColumns({"symbol": F.trim("OFFICIAL_SYMBOL"), "name": F.when(F.col("IDENTIFIER_TYPE") == "ENTREZ_GENE", F.col("IDENTIFIER_ID"))})
    # Hits of other screens go before any shuffle, by a broadcast of ids alone; what is known of a screen comes to its hits last.
    asked = named.join(F.broadcast(good.select("screen_id")), "screen_id", "left_semi").join(genes.select(F.col("symbol").alias("in_scope")), F.upper("symbol") == F.col("in_scope"), "left_semi")
    names = asked.select(F.explode(F.array("name", "symbol")).alias("asked")).filter("asked IS NOT NULL").distinct()
    found = resolve.resolve(names, entities, "asked").select("asked", "id").hint("merge")
    tested = asked.join(found.select(F.col("asked").alias("k_symbol"), F.col("id").alias("by_symbol")), F.col("symbol") == F.col("k_symbol"), "left")
    # Most hits have no such identifier: they stay where their symbol is, for a null would bring all of them to one task.
    own = F.coalesce("name", "symbol")
    tested = tested.join(found.select(F.col("asked").alias("k_name"), F.col("id").alias("by_id")), (own == F.col("k_name")) & F.col("name").isNotNull(), "left").join(good, "screen_id")
    gene, value = F.coalesce("by_id", "by_symbol"), scalars.number(F.col("score_1"))
    why = F.when(gene.isNull(), "unresolved_symbol").when(value.isNull(), "no_numeric_value")
    key = F.concat_ws(":", F.lit("screen"), F.col("screen_id").cast("string"), F.coalesce(gene.cast("string"), F.col("symbol")))
    rows = tested.select(F.lit("screens").alias("source"), key.alias("source_id"), F.when(why.isNull(), F.concat_ws(":", F.lit("meas:orcs"), F.col("screen_id").cast("string"), gene.cast("string"))).alias("id"), "screen_id", gene.alias("gene"), "pmid", "date", "system", "perturbation", "phenotype", value.alias("value"), "hit", F.lit("orcs_screen_score").alias("assay"), why.alias("reject_reason"))
    return tagged, rows


def screen_edges(rows: DataFrame) -> DataFrame:
    """Edges of tested genes: SCREEN_TESTED for every resolved one; MEASURED_IN, PERTURBS and REPORTS for measurements."""
    sid, gene = F.col("screen_id").cast("string"), F.col("gene").cast("string")
    measured = F.col("id").isNotNull()
    edge = lambda when, kind, src, dst: F.when(when, F.struct(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"), F.col("date").alias("effective_date")))
    edges = F.array(
        edge(F.col("gene").isNotNull(), "SCREEN_TESTED", F.concat(F.lit("screen:"), sid), F.concat(F.lit("gene:"), gene)),
        edge(measured, "MEASURED_IN", F.col("id"), F.concat(F.lit("cell:"), F.col("system"))),
        edge(measured, "PERTURBS", F.concat(F.lit("perturbation:"), F.col("perturbation")), F.concat(F.lit("gene:"), gene)),
        edge(measured & F.col("pmid").isNotNull(), "REPORTS", F.concat(F.lit("pub:"), F.col("pmid").cast("string")), F.col("id")),
    )
    return rows.select(F.explode(F.array_compact(edges)).alias("e")).select("e.*")  # one reading of the rows, whose joins four would repeat


def token_cost(usage: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cost of token usage (price per million, rounded to 6), and the models without a price (must be empty)."""
    cost = F.round((F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1_000_000, 6)
    return usage.join(prices, "model").withColumn("cost", cost), usage.select("model").distinct().join(prices, "model", "left_anti")


def discoveries(titles: DataFrame) -> DataFrame:
    """The earliest accepted title (reason null) of each gene by date and pmid."""
    return titles.filter("reason IS NULL").groupBy("gene").agg(F.min(F.struct("date", "pmid")).alias("first")).select("gene", "first.date", "first.pmid")


def near_misses(titles: DataFrame, unnamed: int = 6, others: int = 3) -> DataFrame:
    """Before the accepted title, the first ``unnamed`` that have verb and phenotype but not the gene, and the first
    ``others`` of the rest with a verb (overflow of the former included)."""
    order = Window.partitionBy("gene").orderBy("date", "pmid")
    before = F.max(F.when(F.col("reason").isNull(), 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)).isNull()
    rows = titles.filter("verb").withColumn("early", before).filter("early")
    kind = F.col("phenotype") & ~F.col("named")
    rows = rows.withColumn("k", F.when(kind, F.sum(kind.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    rows = rows.withColumn("class", F.when(F.coalesce("k", F.lit(unnamed + 1)) <= unnamed, "near_miss").otherwise("rejected"))
    place = F.row_number().over(Window.partitionBy("gene", "class").orderBy("date", "pmid"))
    return rows.withColumn("place", place).filter((F.col("class") == "near_miss") | (F.col("place") <= others)).select("gene", "class", "place", "date", "pmid")


def evidence_flow(counts: DataFrame, least: int = 2000) -> DataFrame:
    """(source, outcome, n) to flows; sources with fewer rows than ``least`` are folded into one."""
    total = F.sum("n").over(Window.partitionBy("source"))
    return counts.withColumn("source", F.when(total < least, "other sources").otherwise(F.col("source"))).groupBy("source", "outcome").agg(F.sum("n").alias("n"))


def coverage(titles: DataFrame) -> DataFrame:
    """Records considered, accepted and rejected per gene."""
    return titles.groupBy("gene").agg(F.count("*").alias("considered"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
