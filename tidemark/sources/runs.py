"""Tables that grow by whole runs, each of them exactly once.

A run's rows are staged in a folder of their own, then published by one rename of a small manifest that names this folder. Readers
see the runs that have a manifest, and nothing else: a job that dies before the rename leaves nothing visible, and of two attempts
at one run, in whatever order, the first to rename wins and the other is no part of the table.

    path/staged/ATTEMPT/*.parquet    the rows of an attempt
    path/runs/NAME.json              {"run_id": ..., "attempt": ...}; NAME is the digest of the run's id
"""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    """Hadoop's file context of a path, and a function that makes paths below it."""
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(fs.Path(path).toUri(), spark._jsc.hadoopConfiguration())
    return context, lambda *names: fs.Path("/".join([path.rstrip("/"), *names]))


def committed(spark: SparkSession, path: str) -> dict[str, str]:
    """The runs that are part of the table, each with its attempt: one manifest per run, whatever it holds."""
    files, at = _files(spark, path)
    if not files.util().exists(at("runs")):
        return {}
    found = spark.read.schema("run_id string, attempt string").option("pathGlobFilter", "*.json").json(f"{path.rstrip('/')}/runs")
    return {r["run_id"]: r["attempt"] for r in found.collect()}


def stage(rows: DataFrame, path: str, run_id: str) -> str:
    """Write the rows of an attempt at a run where no reader looks, and give the attempt's name."""
    attempt = uuid.uuid4().hex
    rows.withColumn("run_id", F.lit(run_id)).write.parquet(f"{path.rstrip('/')}/staged/{attempt}")
    return attempt


def commit(spark: SparkSession, path: str, run_id: str, attempt: str) -> bool:
    """Make an attempt its run's rows, by a rename that never replaces a manifest. False if the run was there already."""
    files, at = _files(spark, path)
    jvm, name = spark._jvm, hashlib.sha256(run_id.encode()).hexdigest() + ".json"
    files.mkdir(at("runs"), jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault(), True)
    draft = at("staged", attempt, "_manifest.json")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE, jvm.org.apache.hadoop.fs.CreateFlag.OVERWRITE)
    out = files.create(draft, flags, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$CreateOpts"), 0))
    out.write(json.dumps({"run_id": run_id, "attempt": attempt}).encode())
    out.close()
    try:
        files.rename(draft, at("runs", name), spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        return False
    return True


def append(rows: DataFrame, path: str, run_id: str) -> bool:
    """Add a run. A run that is there already costs a look at its manifest and changes nothing; False then."""
    spark = rows.sparkSession
    return run_id not in committed(spark, path) and commit(spark, path, run_id, stage(rows, path, run_id))


def read(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame | None:
    """The rows of one run or of all, with their run_id; only the folders of these are opened. None if there is no such run."""
    runs = committed(spark, path)
    wanted = list(runs.values()) if run_id is None else [runs[run_id]] if run_id in runs else []
    return spark.read.parquet(*[f"{path.rstrip('/')}/staged/{a}" for a in sorted(wanted)]) if wanted else None


def sweep(spark: SparkSession, path: str) -> int:
    """Remove what attempts left that never became a run's rows; call it while no run is in progress. Gives their number."""
    files, at = _files(spark, path)
    kept, gone = set(committed(spark, path).values()), 0
    for status in files.util().listStatus(at("staged")) if files.util().exists(at("staged")) else ():
        if status.getPath().getName() not in kept:
            gone += files.delete(status.getPath(), True)
    return gone
