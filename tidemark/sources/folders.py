"""Where jobs put what they read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; only a session on one machine may name none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='tidemark-')).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
