"""Prefix sums within keys over many tasks, however many rows one key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.forecast import reliable


def free(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in ("_" * i + s for i in range(1, len(taken) + 3)) if n.lower() not in taken) for s in stems]


def in_ranges(rows: DataFrame, by: list[str], part: str, parts: int | None = None) -> DataFrame:
    """``rows`` range-sorted by ``by``, with the number of their range; rows equal in all of ``by`` share a range. Stored, so
    that all that follows, a recomputed task too, sees the same ranges."""
    cut = rows.repartitionByRange(*([parts] if parts else []), *by)
    return reliable(cut.withColumn(part, F.spark_partition_id()))


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """``rows`` with, for each name of ``sums``, what the rows before it in its key's order add up to (``name``) and what the
    whole key adds up to (``name_total``).

    The scan is segmented: rows are range-sorted by key and order, so a key with most rows lies in many ranges; each range
    sums what it holds of a key; the sums of a key's ranges (a row per key and range) are added up; and each range starts from
    its offset, which comes as a row of its own ahead of the range's rows. No task holds more of a key than one range. Null keys
    are keys; a sum skips nulls and is 0 without any; rows equal in ``order`` come in any order, one after another.
    """
    part, head = free(rows, "part", "head")
    values = dict(zip(sums, free(rows, *[f"value_{i}" for i in range(len(sums))])))
    ends = dict(zip(sums, free(rows, *[f"end_{i}" for i in range(len(sums))])))
    ranged = in_ranges(rows.withColumns({values[n]: c for n, c in sums.items()}), [*keys, *order], part, parts)
    held = ranged.groupBy(*keys, part).agg(*[F.coalesce(F.sum(values[n]), F.lit(0)).alias(values[n]) for n in sums])
    key = Window.partitionBy(*keys)
    ahead = key.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offset = {values[n]: F.coalesce(F.sum(values[n]).over(ahead), F.lit(0)) for n in sums} | {ends[n]: F.sum(values[n]).over(key) for n in sums}
    heads = held.select(*keys, part, F.lit(0).alias(head), *[c.alias(n) for n, c in offset.items()])
    every = ranged.withColumn(head, F.lit(1)).unionByName(heads, allowMissingColumns=True)
    upto = Window.partitionBy(*keys, part).orderBy(head, *order).rowsBetween(Window.unboundedPreceding, -1)
    found = {n: F.coalesce(F.sum(values[n]).over(upto), F.lit(0)) for n in sums} | {f"{n}_total": F.first(ends[n], ignorenulls=True).over(upto) for n in sums}
    return every.withColumns(found).filter(F.col(head) == 1).drop(part, head, *values.values(), *ends.values())
