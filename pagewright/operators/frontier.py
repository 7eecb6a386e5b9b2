"""The link frontier: visited sets, fair interleaving, caps, bounded first-in first-out queues."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions.urls import domain_of, is_institutional

# Fixed values of the crawl.
DOMAIN_LIMIT = 100
QUEUE_CAPACITY = 10_000
SKETCH_URLS = 1_000_000
LEAST_LINKS, MOST_LINKS = 2, 20


def unvisited(urls: DataFrame, visited: DataFrame, column: str = "url") -> DataFrame:
    """Rows whose URL, byte for byte, is not in ``visited`` (column url)."""
    return urls.join(visited.select(F.col("url").alias("__seen")), F.col(column) == F.col("__seen"), "left_anti")


def mark_visited(visited: DataFrame, urls: DataFrame) -> DataFrame:
    return visited.select("url").union(urls.select("url")).distinct()


def first_seen(frontier: DataFrame) -> DataFrame:
    """Each URL once, at its first place in the queue (an aggregate: no URL's rows meet unreduced)."""
    return frontier.groupBy("url").agg(F.min("seq").alias("seq"))


def domain_limit(domain: Column, limit: int = DOMAIN_LIMIT) -> Column:
    return F.when(is_institutional(domain), F.lit(2 * limit)).otherwise(F.lit(limit))


def page_limit(source_domain: Column, usage: float = 0.0) -> Column:
    """Links to enqueue from one page: fewer only when the queue is exactly full."""
    links = min(MOST_LINKS, max(LEAST_LINKS, 100 - int(usage) * 100))
    return F.when(is_institutional(source_domain), F.lit(2 * links)).otherwise(F.lit(links))


def interleave(links: DataFrame) -> DataFrame:
    """``turn``: a page's links taken in turns, internal before external at equal rank."""
    rank = F.row_number().over(Window.partitionBy("page_id", "kind").orderBy("pos"))
    turn = F.row_number().over(Window.partitionBy("page_id").orderBy("rank", F.when(F.col("kind") == "internal", 0).otherwise(1)))
    return links.withColumn("rank", rank).withColumn("turn", turn).drop("rank")


def capped(candidates: DataFrame, visits: DataFrame, limit: int = DOMAIN_LIMIT) -> DataFrame:
    """Candidates (domain, visit_limit, seq) that find their domain under their limit, in order of seq.

    A row is accepted if n0 + r <= ``limit`` (r: its place in its domain) or if it has twice
    that limit and max(n0, limit) plus the rows of that kind since then stays within it.  No
    row past the ``2 * limit``-th of its kind can be accepted, so Spark drops these before the
    shuffle and a hot domain never meets whole.
    """
    order = F.col("seq")
    kind = F.row_number().over(Window.partitionBy("domain", "visit_limit").orderBy(order))
    few = candidates.withColumn("__kind", kind).where(F.col("__kind") <= 2 * limit).drop("__kind")
    few = few.join(visits.select("domain", F.col("n").alias("__n0")), "domain", "left").withColumn("__n0", F.coalesce("__n0", F.lit(0)))
    by_domain = Window.partitionBy("domain").orderBy(order)
    place = few.withColumn("__r", F.col("__n0") + F.row_number().over(by_domain))
    late = F.sum(F.when((F.col("visit_limit") > limit) & (F.col("__r") > limit), 1).otherwise(0)).over(by_domain.rowsBetween(Window.unboundedPreceding, 0))
    fits = (F.col("__r") <= limit) | ((F.col("visit_limit") > limit) & (F.greatest("__n0", F.lit(limit)) + late <= 2 * limit))
    return place.withColumn("__fits", fits).where("__fits").drop("__n0", "__r", "__fits")


def enqueue_links(links: DataFrame, pages: DataFrame, visited: DataFrame, visits: DataFrame, usage: float = 0.0, limit: int = DOMAIN_LIMIT) -> DataFrame:
    """Links to append to the queue: page_id, turn, link.

    The bulk form: unvisited links take turns, each domain admits up to its limit in order of
    (page_id, turn), and each page gives at most its page limit.  It differs from one-by-one
    processing only where a domain is near its cap.
    """
    source = pages.select("page_id", domain_of(F.col("url")).alias("source_domain"))
    fresh = interleave(unvisited(links, visited, "link")).join(source, "page_id")
    own = F.when(F.col("kind") == "internal", F.col("source_domain")).otherwise(domain_of(F.col("link")))
    ready = fresh.select(
        "page_id", "turn", "link", "source_domain", own.alias("domain"), domain_limit(F.col("source_domain"), limit).alias("visit_limit"),
        F.struct("page_id", "turn").alias("seq"),
    )
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("turn"))
    kept = capped(ready, visits, limit).withColumn("place", place)
    return kept.where(F.col("place") <= page_limit(F.col("source_domain"), usage)).select("page_id", F.col("place").alias("turn"), "link")


def oldest(queue: DataFrame, n: int) -> DataFrame:
    """The ``n`` oldest entries, first in first out."""
    return queue.orderBy("seq").limit(n)


def bounded(queue_length: int, arrivals: DataFrame, capacity: int = QUEUE_CAPACITY) -> DataFrame:
    """The arrivals that find room, in order; the rest is dropped as the queue is full."""
    if capacity <= 0:
        raise ValueError("queue capacity must be positive")
    return arrivals.orderBy("seq").limit(max(0, capacity - queue_length))


def queue_usage(queue: DataFrame, capacity: int = QUEUE_CAPACITY) -> DataFrame:
    return queue.agg(F.count("*").alias("length"), (F.count("*") / F.lit(capacity)).alias("usage"))


def is_empty(queue: DataFrame) -> DataFrame:
    """One row: whether the queue holds nothing.  It reads one entry at most."""
    return queue.limit(1).agg((F.count("*") == 0).alias("is_empty"))


def visit_counts(urls: DataFrame, column: str = "url") -> DataFrame:
    return urls.groupBy(domain_of(F.col(column)).alias("domain")).agg(F.count("*").alias("n"))


def sketch_shape(capacity: int = SKETCH_URLS, rate: float = 0.01) -> tuple[int, int]:
    """Bits and hashes for ``capacity`` URLs at a share ``rate`` of false positives."""
    if capacity <= 0 or not 0 < rate < 1:
        raise ValueError("a sketch needs a positive capacity and a rate between 0 and 1")
    bits = ceil(-capacity * log(rate) / log(2) ** 2)
    return bits, ceil(log(2) * bits / capacity)


def save_sketch(sketch: DataFrame, path: str, bits: int, hashes: int = 7) -> None:
    """Write a filter with its shape, without which its bits mean nothing."""
    sketch.write.mode("overwrite").parquet(f"{path}/bits")
    sketch.sparkSession.createDataFrame([(bits, hashes)], "bits long, hashes int").write.mode("overwrite").parquet(f"{path}/shape")


def load_sketch(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """The filter and its bits and hashes."""
    shape = spark.read.parquet(f"{path}/shape").first()
    return spark.read.schema("bit long").parquet(f"{path}/bits"), shape["bits"], shape["hashes"]


def sketch_bits(expected: int = SKETCH_URLS) -> int:
    """Ten bits an expected URL, for ``SKETCH_URLS`` at least: with seven hashes about 1 % of false positives."""
    return 10 * max(expected, SKETCH_URLS)


def sketch_of(urls: DataFrame, bits: int = sketch_bits(), hashes: int = 7, column: str = "url") -> DataFrame:
    """A Bloom filter as the table of its set bits (column bit): at most ``bits`` rows."""
    places = [F.pmod(F.xxhash64(column, F.lit(i)), F.lit(bits)) for i in range(hashes)]
    return urls.select(F.explode(F.array(*places)).alias("bit")).distinct()


def in_sketch(urls: DataFrame, sketch: DataFrame, hashes: int = 7, bits: int = sketch_bits(), column: str = "url") -> DataFrame:
    """``urls`` that the filter may hold: all of their bits are set.  It never misses a held URL."""
    places = F.array(*[F.pmod(F.xxhash64(column, F.lit(i)), F.lit(bits)) for i in range(hashes)])
    probes = urls.select(column).distinct().withColumn("bits", F.array_distinct(places))
    wanted = probes.select(column, F.size("bits").alias("wanted"), F.explode("bits").alias("bit"))
    held = wanted.join(sketch, "bit").groupBy(column, "wanted").agg(F.count("*").alias("held")).where("held = wanted")
    return urls.join(held.select(column), column, "left_semi")
