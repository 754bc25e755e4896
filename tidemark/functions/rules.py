"""Ordered first-match decisions as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import policy
from tidemark.functions.text import has_phrase


def lookup(table: dict, key: Column, default=None) -> Column:
    """A small table as a literal map; a missing or null key gives the default."""
    if not table:
        return F.lit(default)
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def classify_phenotype(text: Column, label: Column, context: Column) -> Column:
    """What a screen measures: ``text`` that names the trait is sorted by the first readout word it contains (a reporter
    without one); else the label before any ``[`` must be one of the fitness labels, or one of the differentiation labels with
    an erythroid ``context``; else null."""
    low = F.lower(text)
    short = F.lower(F.trim(F.substring_index(F.coalesce(label, F.lit("")), "[", 1)))
    readout = F.lit("hbg_reporter")
    for words, kind in reversed(policy.READOUTS):
        readout = F.when(low.rlike("|".join(map(re.escape, words))), kind).otherwise(readout)
    return (
        F.when(has_phrase(text, policy.PHENOTYPE_TERMS), readout)
        .when(short.isin(*policy.FITNESS_LABELS), "cell_fitness")
        .when(short.isin(*policy.DIFFERENTIATION_LABELS) & has_phrase(context, policy.CONTEXT_TERMS), "erythroid_differentiation")
    )


def perturbation_class(kind: Column, method: Column, table: dict[str, str]) -> Column:
    """The kind, else the methodology, through a table; else unspecified."""
    return F.coalesce(lookup(table, F.lower(F.trim(kind))), lookup(table, F.lower(F.trim(method))), F.lit("unspecified"))


def cell_system(accession: Column, species: Column, category: Column, overrides: dict[str, str]) -> Column:
    """An override by accession, then species (unknown counts as human), then category; an immortalised line by default."""
    of, kind = F.lower(F.coalesce(species, F.lit(""))), F.lower(F.coalesce(category, F.lit("")))
    known = lookup(overrides, accession) if overrides else F.lit(None).cast("string")
    return (
        F.when(known.isNotNull(), known)
        .when(of.rlike("|".join(map(re.escape, policy.MOUSE_TERMS))), "mouse_line")
        .when((of != "") & ~of.rlike("sapiens|human"), "non_human_other")
        .when(kind.contains("cancer"), "human_cancer_line")
        .when(kind.rlike("transformed|immortal"), "human_immortalized_line")
        .when(kind.rlike("stem cell|primary|finite"), "primary_human_hspc")
        .otherwise("human_immortalized_line")
    )


def first_contained(text: Column, patterns: dict[str, str], default: str | None = None) -> Column:
    """The value of the first of the ordered patterns that the lower-cased text contains."""
    out = F.lit(default)
    for part, value in reversed(patterns.items()):
        out = F.when(F.contains(F.lower(text), F.lit(part)), value).otherwise(out)
    return out


def route(family: Column, locus: Column, pan_essential: Column, raises: Column, cis_element: Column) -> Column:
    """The therapeutic route as struct<route, reason, word, weight>; the order of the tests is the policy."""
    text = F.coalesce(family, F.lit(""))
    small, dna, many = ("(?i)(" + "|".join(x) + ")" for x in (policy.SMALL_MOLECULE_FAMILIES, policy.DNA_BINDING_FAMILIES, policy.COMPLEX_FAMILIES))

    def call(name: str, reason: str, word: Column | None = None) -> Column:
        return F.struct(F.lit(name).alias("route"), F.lit(reason).alias("reason"), (F.lit(None).cast("string") if word is None else word).alias("word"), F.lit(policy.ROUTE_WEIGHTS[name]).alias("weight"))

    return (
        F.when(F.coalesce(pan_essential, F.lit(False)), call("NOT_THERAPEUTIC", "pan-essential"))
        .when(~F.coalesce(raises, F.lit(True)), call("NOT_THERAPEUTIC", "does not raise the phenotype"))
        .when(F.coalesce(locus, F.lit("")).rlike(".") & ~F.lower(locus).contains("protein product"), call("EX_VIVO_SINGLE_EDIT", "no protein product"))
        .when(text.rlike(small), call("SMALL_MOLECULE", "enzyme class", F.regexp_extract(text, small, 1)))
        .when(F.coalesce(cis_element, F.lit(False)), call("EX_VIVO_SINGLE_EDIT", "cis-regulatory element"))
        .when(text.rlike(many), call("EX_VIVO_MULTI_EDIT", "complex", F.regexp_extract(text, many, 1)))
        .when(text.rlike(dna), call("EX_VIVO_SINGLE_EDIT", "DNA-binding protein", F.regexp_extract(text, dna, 1)))
        .otherwise(call("EX_VIVO_SINGLE_EDIT", "no class that implies a small molecule"))
    )


def reportable(confidence: Column, support: Column, publications: Column, composition: Column) -> Column:
    """Confident enough, and strong by one measurement, by literature, or by a partner."""
    strong = (F.coalesce(support, F.lit(0.0)) >= policy.LEAST_SUPPORT) | (F.coalesce(publications, F.lit(0)) >= policy.LEAST_PUBLICATIONS) | (F.coalesce(composition, F.lit(0.0)) >= policy.LEAST_COMPOSITION)
    return (confidence >= policy.REFUSAL_THRESHOLD) & strong


def places(value: Column, n: int) -> Column:
    """A number with ``n`` decimals as C's printf writes it: its binary value counts, halves go to the even digit
    (``format_string`` rounds the shortest decimal half up: 0.1235, which is less than that, to 0.124)."""
    x, scale = F.abs(value.cast("double")), 10**n
    below = F.floor(x * scale)
    half = 2 * below + 1
    near = half / (2 * scale)  # the double next to the tie: only a number equal to it can be on either side
    high = x * 134217729.0 - (x * 134217729.0 - x)  # 26 bits, so that both products below are exact
    beyond = (high * (2 * scale) - half) + (x - high) * (2 * scale)
    up = (x > near) | ((x == near) & ((beyond > 0) | ((beyond == 0) & (below % 2 == 1))))
    rounded = below + up.cast("long")
    digits = F.format_string(f"%d.%0{n}d", F.floor(rounded / scale), rounded % scale)
    shown = F.when(x < 1e9, F.concat(F.when(value < 0, "-").otherwise(""), digits))
    return F.coalesce(shown, F.format_string(f"%.{n}f", value))


def refusal_reason(confidence: Column, support: Column) -> Column:
    """Which condition a refused claim fails first."""
    low = F.concat(F.lit("confidence "), places(confidence, 3), F.lit(f" is below {policy.REFUSAL_THRESHOLD:.2f}"))
    weak = F.concat(F.lit("strongest support "), places(F.coalesce(support, F.lit(0.0)), 3), F.lit(f" is below {policy.LEAST_SUPPORT:.2f} and no other route holds"))
    return F.when(confidence < policy.REFUSAL_THRESHOLD, low).otherwise(weak)


def verdict(established: Column, forecast: Column, refused: Column, truth: Column) -> Column:
    """P25: what a slice said about a gene."""
    return F.when(established, "known").when(forecast & truth, "hit").when(forecast, "forecast").when(truth, "missed").when(refused, "refused").otherwise("none")


def explain_weight(*terms: tuple[str, Column]) -> Column:
    """The factors of a weight as text."""
    return F.concat_ws(" * ", *[F.concat(F.lit(f"{name}="), places(value, 2)) for name, value in terms])


def in_enum(value: Column, *allowed: str) -> Column:
    """True only for one of the allowed values; null is not one."""
    return F.coalesce(value.isin(*allowed), F.lit(False))
