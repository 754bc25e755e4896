"""Small helpers that several operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word contracts define it: blank and the five ASCII controls from tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder. A session on one machine (tests) may name none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = f"file://{tempfile.gettempdir()}/tidemark-{os.getpid()}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it from there, which cuts its lineage."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark, "checkpoint"))
    return df.checkpoint()


def stored(df: DataFrame, session: SparkSession | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back (by ``session``): computed once, whoever reads it."""
    path = shared_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)


def session_with(spark: SparkSession, **settings: str) -> SparkSession:
    """A session of its own with the settings of ``spark`` and some others, which the caller's session never sees."""
    own = spark.newSession()
    for name, value in {**dict(spark.conf.getAll), **settings}.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    return own


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank texts have none."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare.isNull() | (bare == ""), F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_RUN))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever columns the caller brings."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def require(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns of ``df``, so that no other column of the caller's can clash with the operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])
