"""Seed lists and small side files."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.session import staged

USER_AGENTS = "array<struct<ua:string,pct:double>>"


def seed_lines(spark: SparkSession, path: str) -> DataFrame:
    """One URL or bare domain a line, with its place as column seq, from 1.

    Lines are in order of file, block and place in the block, so large files are read in splits.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("url"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__row"),
    )
    return numbered(lines, "__file", "__start", "__row").select("seq", "url")


def cycled(seeds: DataFrame, rounds: int) -> DataFrame:
    """The list read over and over, ``rounds`` times: seq goes on from one round to the next."""
    n = seeds.count()
    again = seeds.withColumn("__round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))) if rounds > 0 else seeds.limit(0).withColumn("__round", F.lit(0))
    return again.withColumn("seq", F.col("seq") + F.col("__round") * F.lit(n)).drop("__round")


def numbered(seeds: DataFrame, *order: str) -> DataFrame:
    """``seeds`` with their place by ``order``, from 1 and nulls last, as column seq.

    Rows are dealt by range; a range's first number is the rows before it, from one count a
    range, and a window numbers the rows inside one range.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    # staged, as ranges that are drawn anew could differ between the count and the numbers
    ranged = staged(seeds.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()), "seed-ranges")
    first, before = [], 0
    for r in sorted(ranged.groupBy("__range").count().collect()):
        first.append((r["__range"], before))
        before += r["count"]
    starts = seeds.sparkSession.createDataFrame(first, "__range int, __first long")
    inside = Window.partitionBy("__range").orderBy(*by)
    placed = ranged.withColumn("__place", F.row_number().over(inside)).join(F.broadcast(starts), "__range")
    return placed.select((F.col("__first") + F.col("__place")).alias("seq"), *seeds.columns)


def resumed(seeds: DataFrame, done: int) -> DataFrame:
    """Seeds (seq, url; seq from 1) after the first ``done``."""
    return seeds.where(F.col("seq") > done)


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def save_progress(spark: SparkSession, path: str, done: int) -> None:
    """Keep the number of seeds done in a file of the shared storage, written whole or not at all."""
    fs, at = _file(spark, path)
    _, part = _file(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(f"{done}\n".encode())
    out.close()
    fs.delete(at, False)
    if not fs.rename(part, at):
        raise OSError(f"cannot write {path}")


def load_progress(spark: SparkSession, path: str) -> int:
    """The number of seeds done; 0 where the file is missing or holds no number."""
    fs, _ = _file(spark, path)
    for name in (path, f"{path}.part"):  # the part stays alone where a save was cut off before its rename
        _, at = _file(spark, name)
        if fs.exists(at):
            lines = [r["value"].strip() for r in spark.read.text(name).limit(1).collect()]
            return int(lines[0]) if lines and lines[0].isascii() and lines[0].isdigit() else 0
    return 0


def counted(rows: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """``rows``, and an observation whose ``get["rows"]`` is their number once they have been used."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def pick_agents(requests: DataFrame, agents: DataFrame, key: str = "url", weighted: bool = False, most: int = 10_000) -> DataFrame:
    """``requests`` with a user agent (column ua) drawn by a hash of ``key``: the same for every retry.

    Each of ``agents`` (ua, pct) is as likely as any other or, if ``weighted``, as its pct.  They
    are taken in order of (ua, pct); the list is held in the plan, so it has ``most`` entries at
    most.  An empty list is an error.
    """
    held = sorted(((r["ua"], r["pct"]) for r in agents.select("ua", "pct").where("ua IS NOT NULL").limit(most + 1).collect()), key=lambda x: (x[0], x[1] or 0.0))
    held = [(ua, pct) for ua, pct in held if not weighted or (pct or 0.0) > 0]
    if not held:
        raise ValueError("no user agents")
    if len(held) > most:
        raise ValueError(f"more than {most} user agents")
    bounds = list(accumulate(pct if weighted else 1.0 for _, pct in held))
    draw = F.conv(F.substring(F.md5(F.coalesce(key, F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * F.lit(bounds[-1])
    places = F.array(*[F.struct(F.lit(bound).alias("bound"), F.lit(ua).alias("ua")) for bound, (ua, _) in zip(bounds, held, strict=True)])
    return requests.withColumn("ua", F.element_at(F.filter(places, lambda x: x["bound"] > draw), 1)["ua"])


def user_agents(text: DataFrame) -> DataFrame:
    """The entries of JSON lists in column ``value``."""
    return text.select(F.explode(F.from_json("value", USER_AGENTS)).alias("entry")).select("entry.ua", "entry.pct")


def pages_json(records: DataFrame) -> DataFrame:
    """Each accepted record as JSON with all its fields, null ones too."""
    kept = records.where(F.coalesce("fetch_error", F.lit("")) == "")
    return kept.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_pages_json(records: DataFrame, path: str) -> None:
    """Write the accepted records below ``path``, one JSON object a line."""
    pages_json(records).select(F.col("json").alias("value")).write.mode("overwrite").text(path)
