"""Session and cluster-folder helpers that every other module may use."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once an application.

    Spark serves the archive from the driver, so no worker needs it in its own path.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    home = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as scratch:
        copy = Path(scratch, "tree", home.name)
        shutil.copytree(home, copy, ignore=shutil.ignore_patterns("__pycache__"))
        keep = tempfile.mkdtemp(prefix="pagewright-")
        context.addPyFile(shutil.make_archive(f"{keep}/{home.name}", "zip", copy.parent))


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Hand long texts to Python in batches of bounded rows and bytes, unless the session has
    settings of its own: a batch is held by the executor and, as Arrow and as objects, by its worker."""
    for name, value in (("maxRecordsPerBatch", str(rows)), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset (a
    single-machine test session) a local temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pagewright-"))
    return context.getCheckpointDir().rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Lineage ends there, so a lost executor costs a re-read and never a recomputation,
    and what follows can read single columns of it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.staged_at = path
    return found


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``staged`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(spark: SparkSession) -> None:
    """Delete every table that ``staged`` has written below the shared folder."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/staged-*")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(pattern) or []:
        fs.delete(status.getPath(), True)
