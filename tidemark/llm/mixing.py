"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], linear from ``start`` to ``end`` times its base weight.
``source_targets`` splits the budget (all sizes) by base weight, holds every source to ``MOST_PASSES`` times its size and
reshares the rest. ``place`` integrates a source's schedule into its cumulative token demand, lays the source's documents
end to end in a fixed random order, pass after pass up to the target, inverts the demand at the place where a document
begins and so gets its training position; ``training_order`` range-sorts by it.

Null texts have size 0; null sources are one source, last in order. Documents of size 0 and empty tables take nothing.
Repeated rows each count, one after another: rows that agree in doc_id, source and size are ordered by their texts' hash,
and rows that agree in these too are interchangeable. Other columns of the input are only carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, require, word_count

MOST_PASSES = 3
BASE_WEIGHTS = (1, 2, 3)
#: Factor on a source's weight at t = 0 and at t = 1, by its base weight: light sources early, heavy ones late.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.75, 1.25))


def sized(documents: DataFrame) -> DataFrame:
    return require(documents, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: source, source_size, weight, target; from ``sized``. Windows here run over sources, not rows."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(BASE_WEIGHTS)
    weighted = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, BASE_WEIGHTS)), k + 1))
    # Sources reach their cap in the order of cap per weight; the level is what the open ones share per unit of weight.
    cap = F.col("source_size") * MOST_PASSES
    fill = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    leveled = weighted.withColumn("level", level).withColumn("open", cap / F.col("weight") > F.col("level"))
    share = F.max(F.when(F.col("open"), F.col("level"))).over(everything)  # the first open source's; it falls behind it
    target = F.when(F.col("open"), F.round(share * F.col("weight"), 6)).otherwise(cap.cast("double"))
    return leveled.withColumn("target", target).select("source", "source_size", "weight", "target")


def demand_inverse(share: Column, start: Column, end: Column) -> Column:
    """The t at which a source has given the ``share`` (0 to 1) of its tokens, weights going linearly from start to end.

    The integral to t is start*t + (end-start)*t^2/2, over (start+end)/2 in all.
    """
    rest = share * (start + end) / 2
    slope = end - start
    root = F.sqrt(F.greatest(start * start + 2 * slope * rest, F.lit(0.0)))
    return F.when(slope == 0, share).otherwise((root - start) / slope + 0.0)


def place(documents: DataFrame, carry: bool = False) -> DataFrame:
    """One row per document and pass: doc_id, source, size, source_size, target, doc_taken, pass, taken, position; with
    ``carry`` also doc, the document's row as a struct.

    A document that the mix never reaches has one row with pass 0, taken 0 and a null position. ``taken`` is the words of
    this pass (fewer than size where the target ends inside the document), ``doc_taken`` their sum over all passes. The
    order inside a source is by md5 of the doc_id; prefix sums go through buckets of that hash, so a source that holds
    most rows is summed in many tasks.
    """
    hashed = lambda df: df.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = durable(hashed(sized(documents)))
    rows = sizes.count()
    digits = max(1, math.ceil(math.log(max(rows, 1) / 4096 + 1, 16)))
    bucketed = lambda df: df.withColumn("bucket", F.substring("h", 1, digits))
    sizes = bucketed(sizes)
    targets = source_targets(sizes)
    sums = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("ahead"))
    schedule = F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in SCHEDULES])
    factors = F.element_at(schedule, F.array_position(F.array(*map(F.lit, BASE_WEIGHTS)), F.col("weight")).cast("int"))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target", factors.alias("factors"))
    b = sums.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "ahead", "source_size", "target", "factors")
    ties = ["h", "doc_id", "size"]
    if carry:  # each row goes its own way from here, so that repeated rows are told apart without a key
        doc = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc")
        sizes = bucketed(hashed(documents.select(doc).select(*[F.col(f"doc.`{c}`").alias(c) for c in ("doc_id", "source")], word_count(F.col("doc.text")).alias("size"), "doc")))
        ties += [F.xxhash64("doc.text")]
    inside = Window.partitionBy("source", "bucket").orderBy(*ties).rowsBetween(Window.unboundedPreceding, -1)
    laid = sizes.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    laid = laid.join(b, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")), "left")
    start = lambda p: F.col("ahead") + F.col("within") + F.lit(p) * F.col("source_size")
    goal = F.round("target").cast("long")
    taken = [F.greatest(F.least(goal - start(p), F.col("size")), F.lit(0)).cast("long") for p in range(MOST_PASSES)]
    passes = F.array(*[F.struct(F.lit(p + 1).alias("pass"), taken[p].alias("taken"), start(p).alias("start")) for p in range(MOST_PASSES)])
    some = F.filter(passes, lambda x: x["taken"] > 0)
    none = F.array(F.struct(F.lit(0).alias("pass"), F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("start")))
    out = laid.withColumn("doc_taken", sum(taken[1:], taken[0])).withColumn("p", F.explode(F.when(F.size(some) > 0, some).otherwise(none)))
    position = demand_inverse(F.col("p.start") / goal, F.col("factors")[0], F.col("factors")[1])
    out = out.withColumn("position", F.when(F.col("p.taken") > 0, position))
    return out.select("doc_id", "source", "size", "source_size", "target", "doc_taken", "p.pass", "p.taken", "position", *["doc"] * carry)


def training_order(placed: DataFrame) -> DataFrame:
    """Range-sort by training position; passes that are never reached stand at the end."""
    return placed.repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id"), F.col("pass")).sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id", "pass")


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The documents as the mix takes them, in training order: one row per pass, its text cut to the words taken.

    Keeps the columns of ``documents``; n_chars, if there, is the length of the text that is left. The words of a source
    in the result are those that its target takes, repeated rows included.
    """
    placed = place(documents, carry=True).filter("taken > 0")
    text = F.col("doc.text")
    starts = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    blank_first = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    part = F.array_join(F.slice(starts, F.lit(1), F.col("taken").cast("int") + blank_first), "")
    left = F.when(F.col("taken") >= F.col("size"), text).otherwise(part)
    order = ["position", "doc_id", "pass"]
    sorted_ = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_.select(*[left.alias(c) if c == "text" else F.char_length(left).cast("long").alias(c) if c == "n_chars" else F.col(f"doc.`{c}`").alias(c) for c in documents.columns])
