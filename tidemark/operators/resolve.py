"""Names to entities, dates and cells to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import has_phrase


def unique_names(entities: DataFrame, names: Column, distinct_owners: bool = False) -> DataFrame:
    """(name, owner) for names that one entity owns; names are upper-cased and grouped before any join.

    With ``distinct_owners`` a name listed twice for one entity still is its own; otherwise that makes it ambiguous.
    """
    rows = entities.select(F.col("id").alias("owner"), F.explode(names).alias("name")).select("owner", F.upper(F.trim("name")).alias("name")).filter("name <> ''")
    rows = rows.distinct() if distinct_owners else rows
    return rows.groupBy("name").agg(F.min("owner").alias("owner"), F.count("*").alias("owners"))


def resolve(names: DataFrame, entities: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with id and reason. ``entities``: id, symbol, entrez, ensembl, aliases, previous.

    Precedence: entrez id, ensembl id, approved symbol, unique alias or withdrawn symbol. A name without an entity gets the
    reason 'empty', 'ambiguous N' or 'unknown'.
    """
    key = F.upper(F.trim(F.col(name)))
    by = lambda c, out: entities.filter(F.col(c).isNotNull()).groupBy(F.upper(F.trim(c)).alias(f"k_{out}")).agg(F.min("id").alias(out))
    empty = F.array().cast("array<string>")
    alias = unique_names(entities, F.concat(F.coalesce("aliases", empty), F.coalesce("previous", empty))).select(F.col("name").alias("k_alias"), F.col("owner").alias("alias_owner"), "owners")
    out = names
    for table, k in ((by("entrez", "by_entrez"), "k_by_entrez"), (by("ensembl", "by_ensembl"), "k_by_ensembl"), (by("symbol", "by_symbol"), "k_by_symbol"), (alias, "k_alias")):
        out = out.join(table.hint("merge"), key == F.col(k), "left")  # a few bytes of file each, but as many rows as entities: too many to broadcast
    found = F.coalesce("by_entrez", "by_ensembl", "by_symbol", F.when(F.col("owners") == 1, F.col("alias_owner")))
    reason = F.when(found.isNotNull(), F.lit(None)).when(F.coalesce(key, F.lit("")) == "", "empty").when(F.col("owners") > 1, F.concat(F.lit("ambiguous "), F.col("owners").cast("string"))).otherwise("unknown")
    return out.select(*names.columns, found.alias("id"), reason.alias("reason"))


def resolve_in_graph(names: DataFrame, entities: DataFrame, name: str = "name") -> DataFrame:
    """Inside a slice, the approved symbol wins, else the alias of exactly one entity. ``entities``: id, symbol, aliases."""
    key = F.upper(F.trim(F.col(name)))
    symbols = entities.groupBy(F.upper("symbol").alias("k_symbol")).agg(F.min("id").alias("by_symbol"))
    aliases = unique_names(entities, F.coalesce("aliases", F.array().cast("array<string>")), distinct_owners=True).filter("owners = 1").select(F.col("name").alias("k_alias"), F.col("owner").alias("by_alias"))
    out = names.join(symbols.hint("merge"), key == F.col("k_symbol"), "left").join(aliases.hint("merge"), key == F.col("k_alias"), "left")  # names shuffle to few bytes, too many to broadcast
    return out.select(*names.columns, F.coalesce("by_symbol", "by_alias").alias("id"))


def alias_probe_score(probes: DataFrame, entities: DataFrame) -> DataFrame:
    """(probes, resolved right): ``probes`` has name and expected."""
    got = resolve_in_graph(probes, entities)
    return got.agg(F.count("*").alias("probes"), F.count_if(F.col("id") == F.col("expected")).alias("resolved"))


def attach_dates(evidence: DataFrame, dates: DataFrame, own: str) -> DataFrame:
    """The resolved date of the publication, else the record's own."""
    return evidence.join(dates.select("pmid", F.col("date").alias("resolved")), "pmid", "left").withColumn("date", F.coalesce("resolved", own)).drop("resolved")


def resolve_cells(rows: DataFrame, cells: DataFrame, primary: tuple[str, ...], mouse: tuple[str, ...]) -> DataFrame:
    """The cell's system by accession; else by terms in the name and type; else null."""
    found = rows.join(cells.select("accession", F.col("system").alias("by_accession")), "accession", "left")
    blob = F.concat_ws(" ", "cell_name", "cell_type")
    return found.withColumn("system", F.coalesce("by_accession", F.when(has_phrase(blob, primary), "primary_human_hspc"), F.when(has_phrase(blob, mouse), "mouse_model"))).drop("by_accession")


def group_pairs(members: DataFrame, suffix: str | None = None) -> DataFrame:
    """Both directions of each pair of members that share a group: src, dst, groups, date (of the later member).

    ``members``: id, group, date. Groups are small by nature (complex subunits); ``suffix`` keeps those named so.
    """
    rows = members.filter(F.endswith(F.lower("group"), F.lit(suffix))) if suffix else members
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.group") == F.col("b.group")) & (F.col("a.id") < F.col("b.id"))).groupBy(F.col("a.id").alias("src"), F.col("b.id").alias("dst")).agg(F.array_sort(F.collect_set("a.group")).alias("groups"), F.max(F.greatest("a.date", "b.date")).alias("date"))
    return pairs.union(pairs.select(F.col("dst"), F.col("src"), "groups", "date"))
