"""Scalar expressions: dates at day precision, numbers in text, odds, hashes, p-values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import policy

DAY = r"^\d{4}-\d{2}-\d{2}"


def day(text: Column) -> Column:
    """the date that a text begins with, at day precision; a year or month is never widened to a day."""
    return F.when(text.rlike(DAY), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def first_day(*texts: Column) -> Column:
    """The first of several texts with day precision, as struct<date, rule>; rule is its place from 0, or null."""
    dates = [day(t) for t in texts]
    rule = F.coalesce(*[F.when(d.isNotNull(), F.lit(i)) for i, d in enumerate(dates)])
    return F.struct(F.coalesce(*dates).alias("date"), rule.alias("rule"))


def effective_date(scope: Column, effective: Column, published: Column) -> Column:
    """Vocabulary rows are as old as the calendar; others need a date of their own, else null (rejected)."""
    return F.when(scope == "VOCABULARY", F.lit("0001-01-01").cast("date")).otherwise(F.coalesce(effective, published))


def number(text: Column) -> Column:
    """Trimmed, commas dropped; empty, '-', words, NaN and infinities are null."""
    value = F.trim(F.replace(text, F.lit(","), F.lit(""))).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def log_odds(p: Column) -> Column:
    clamped = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(clamped / (1 - clamped))


def from_log_odds(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def content_hash(*fields: Column) -> Column:
    """SHA-256 of the chosen fields in the order given, nulls told apart from empty text."""
    return F.sha2(F.to_json(F.array(*[f.cast("string") for f in fields]), {"ignoreNullFields": "false"}), 256)


def association_p(p: Column, mantissa: Column, exponent: Column) -> Column:
    """The p-value, or mantissa * 10^exponent where it is null or zero; not above zero is null."""
    whole = F.when(F.coalesce(p, F.lit(0.0)) == 0, mantissa * F.pow(F.lit(10.0), exponent)).otherwise(p)
    return F.when(whole > 0, whole)


def p_strength(p: Column) -> Column:
    return -F.log10(p)


def significant(p: Column, most: float = policy.GENOME_WIDE) -> Column:
    """A missing or zero p counts as 1."""
    return F.when(p.isNull() | (p == 0), F.lit(1.0)).otherwise(p) < most
