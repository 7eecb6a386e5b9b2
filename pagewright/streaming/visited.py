"""Continuous forms: first sight of a URL, running counts by domain."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.urls import domain_of
from pagewright.session import shared_dir


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Pages as they arrive below ``path``; the source limit is the back-pressure."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        # a stream watches a folder: the file's own, for this name
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return reader.parquet(path)


def first_sights(stream: DataFrame) -> DataFrame:
    """Each URL once over the life of the stream.  Its state grows with the number of URLs."""
    return stream.dropDuplicates(["url"])


def domain_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy(domain_of(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


def drained(result: DataFrame, mode: str, name: str | None = None) -> DataFrame:
    """Run a streaming result over all that has arrived, into the shared folder, and read it.

    With a ``name`` the checkpoint and the rows keep their place, so a later call goes on where
    the last one ended.  A batch that is run again replaces its own rows: each has a folder of
    its own, and of a complete result only the newest counts.
    """
    spark = result.sparkSession
    at = f"{shared_dir(spark)}/stream-{name or uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        folder = "rows" if mode == "complete" else f"rows/batch={number}"
        batch.write.mode("overwrite").parquet(f"{at}/{folder}")

    # state with timeouts asks for one empty batch after another; a drain ends with its data
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    spark.conf.set(empty, "false")
    try:
        query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    finally:
        spark.conf.set(empty, before)
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{at}/rows").select(*result.columns)
