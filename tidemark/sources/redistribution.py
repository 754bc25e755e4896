"""P20: fields and texts that must not be passed on."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.policy import FORBIDDEN_FIELDS, LONG_FIELDS, LONGEST_FIELD

#: Items of a list that are looked at.
LIST_ITEMS = 50


def normal(name: str) -> str:
    return name.strip().lower().replace("-", "_")


def may_be_long(name: str) -> bool:
    return name.lower() in LONG_FIELDS


def findings_in(value, path: str) -> list[str]:
    """What a decoded JSON value holds against the rule, by its path; any depth."""
    found: list[str] = []
    if isinstance(value, dict):
        for name, inner in value.items():
            here = f"{path}.{name}"
            if normal(name) in FORBIDDEN_FIELDS:
                found.append(f"{here}: forbidden field")
            if isinstance(inner, str) and len(inner) > LONGEST_FIELD and not may_be_long(name):
                found.append(f"{here}: long text")
            found += findings_in(inner, here)
    elif isinstance(value, list):
        for i, inner in enumerate(value[:LIST_ITEMS]):
            found += findings_in(inner, f"{path}[{i}]")
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def _json_findings(texts: pd.Series, paths: pd.Series) -> pd.Series:
    def one(text, path):
        try:
            return findings_in(json.loads(text), path) if text else []
        except ValueError:
            return [f"{path}: not JSON"]

    return pd.Series([one(t, p) for t, p in zip(texts, paths)])


def scan(table: DataFrame, json_columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows with findings (array of text): forbidden names at any depth and over-long strings; null fields are no finding.

    The schema is walked once on the driver, through structs, arrays of structs and maps, so that plain columns cost length
    tests only. ``json_columns`` hold JSON text, whose names are data: they are decoded in Arrow batches. Lists are looked at
    up to 50 items; the texts inside a list of texts are no fields.
    """

    def fields(kind: T.StructType, value, path: str) -> list[Column]:
        out = []
        for f in kind.fields:
            inner, here = value[f.name], f"{path}.{f.name}" if path else f.name
            out += named(f.name, f.dataType, inner, here)
        return out

    def named(name: str, kind: T.DataType, value, here: str) -> list[Column]:
        out = [F.when(value.isNotNull(), F.array(F.lit(f"{here}: forbidden field")))] if normal(name) in FORBIDDEN_FIELDS else []
        if isinstance(kind, T.StringType) and not may_be_long(name):
            out.append(F.when(F.char_length(value) > LONGEST_FIELD, F.array(F.lit(f"{here}: long text"))))
        return out + below(kind, value, here)

    def below(kind: T.DataType, value, here: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return fields(kind, value, here)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.MapType, T.ArrayType)):
            return [F.flatten(F.transform(F.slice(value, 1, LIST_ITEMS), lambda x: together(below(kind.elementType, x, here + "[]"))))]
        if isinstance(kind, T.MapType):
            keys = F.map_keys(value)
            bad = F.transform(F.filter(keys, lambda k: F.replace(F.lower(F.trim(k)), F.lit("-"), F.lit("_")).isin(*FORBIDDEN_FIELDS)), lambda k: F.concat(F.lit(f"{here}."), k, F.lit(": forbidden field")))
            out = [bad]
            if isinstance(kind.valueType, T.StringType):
                out.append(F.transform(F.filter(keys, lambda k: (F.char_length(value[k]) > LONGEST_FIELD) & ~F.lower(k).isin(*LONG_FIELDS)), lambda k: F.concat(F.lit(f"{here}."), k, F.lit(": long text"))))
            else:
                out += [F.flatten(F.transform(F.map_values(value), lambda x: together(below(kind.valueType, x, here + ".*"))))]
            return out
        return []

    def together(parts: list[Column]) -> Column:
        empty = F.array().cast("array<string>")
        return F.flatten(F.array(*[F.coalesce(p, empty) for p in parts])) if parts else empty

    found: list[Column] = []
    for f in table.schema.fields:
        column = F.col(f"`{f.name}`")
        if f.name in json_columns:
            found.append(_json_findings(column, F.lit(f.name)))
        else:
            found += named(f.name, f.dataType, column, f.name)
    return table.withColumn("findings", together(found))
