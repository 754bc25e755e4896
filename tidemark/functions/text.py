"""Text expressions: folded titles, term patterns, negated names, phrases, markup."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import policy

_LETTER = "[0-9A-Za-z]"


def fold_greek(text: Column) -> Column:
    """each Greek letter of the table becomes its name."""
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), policy.GREEK.items(), text)


def usable_terms(symbol: Column, terms: Column, short_allowed: tuple[str, ...] = (), least: int = 4) -> Column:
    """the symbol, allowed short terms, and terms of four characters or more; sorted, distinct."""
    long = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: (F.char_length(t) >= least) | t.isin(*short_allowed))
    return F.array_sort(F.array_distinct(F.concat(F.array(symbol), long)))


def term_pattern(term: str) -> str:
    """runs of letters or digits joined by any hyphens and blanks, with no letter or digit at either side."""
    runs = re.findall(r"[0-9]+|[A-Za-z]+", term)
    return rf"(?<!{_LETTER})" + r"[-\s]*".join(map(re.escape, runs)) + rf"(?!{_LETTER})"


def names_any(title: Column, terms: list[str]) -> Column:
    """some term stands in the folded title and isn't negated right before that place (up to 24 characters back)."""
    body = names_pattern(terms)
    return fold_greek(title).rlike(body) if body else F.lit(False)


def names_pattern(terms: list[str]) -> str:
    """F10 as a pattern, empty if no term has a letter or digit. The term is looked for first: a negation, which may lie many
    places back, only where one stands."""
    negated = "|".join(r"\s+".join(map(re.escape, n.split())) for n in policy.NEGATIONS)
    body = "|".join(term_pattern(t) for t in sorted(terms, key=lambda t: (-len(t), t)) if re.search(r"[0-9A-Za-z]", t))
    return rf"(?i)(?={body})(?<!(?:{negated})\s{{0,{policy.NEGATION_WINDOW}}})(?:{body})" if body else ""


def has_phrase(text: Column, terms: tuple[str, ...]) -> Column:
    """One of the phrases stands in the lower-cased text between other characters than letters and digits."""
    body = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return F.coalesce(F.lower(text).rlike(rf"(?<![0-9a-z])(?:{body})(?![0-9a-z])"), F.lit(False))


def expand_terms(symbol: Column, aliases: Column, informal: Column, stop: tuple[str, ...] = ()) -> Column:
    """symbol, aliases of three characters or more outside the stop list, informal names of four or more."""
    empty = F.array().cast("array<string>")
    a = F.filter(F.coalesce(aliases, empty), lambda t: (F.char_length(t) >= 3) & (~t.isin(*stop) if stop else F.lit(True)))
    i = F.filter(F.coalesce(informal, empty), lambda t: F.char_length(t) >= 4)
    return F.array_sort(F.array_distinct(F.concat(F.array(symbol), a, i)))


def informal_names(names: dict[str, tuple[str, ...]], symbol: Column) -> Column:
    """the informal names under which a symbol is written, in order; none for a symbol that the table lacks."""
    of: dict[str, list[str]] = {}
    for name, symbols in names.items():
        for s in symbols:
            of.setdefault(s, []).append(name)
    empty = F.array().cast("array<string>")
    if not of:
        return empty
    return F.coalesce(F.try_element_at(F.create_map(*[x for s, n in sorted(of.items()) for x in (F.lit(s), F.array(*map(F.lit, sorted(n))))]), symbol), empty)


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def strip_markup(html: Column) -> Column:
    """scripts, styles and tags out, entities back, white space squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    bare = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), _ENTITIES, bare)
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def labelled_value(text: Column, label: str, labels: tuple[str, ...]) -> Column:
    """What follows ``label :`` up to the next label (or the end); null if the label isn't there."""
    stop = "|".join(re.escape(x) + r"\s*:" for x in labels)
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?s){re.escape(label)}\s*:(.*?)(?={stop}|$)", 1)), F.lit(""))


def primary_claim(title: Column, names_gene: Column, verbs: tuple[str, ...], phenotype: tuple[str, ...], review_words: tuple[str, ...], kinds: Column, bad_kinds: tuple[str, ...] = ("review", "editorial", "comment", "letter", "news")) -> Column:
    """Null if a title is a primary claim, else the first reason why not. ``kinds``: publication types, ';' between."""
    listed = F.transform(F.split(F.coalesce(kinds, F.lit("")), ";"), lambda k: F.lower(F.trim(k)))
    return (
        F.when(~names_gene, "does not name the gene")
        .when(~has_phrase(title, verbs), "no regulatory verb")
        .when(~has_phrase(title, phenotype), "no phenotype term")
        .when(has_phrase(title, review_words), "review-like title")
        .when(F.arrays_overlap(listed, F.array(*map(F.lit, bad_kinds))), "publication type")
    )
