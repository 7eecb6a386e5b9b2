"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source has a target share of all bytes; its mean repetition rate is that share of the
wanted bytes divided by the bytes the source has.  A document's number of copies is the
inverse of the Poisson distribution with that mean at a uniform number made from a hash of
the seed and the document's id.  The document is exploded into its copies, and a hash of
seed, id and copy number deals the copies to tasks and orders them there, which is a uniform
shuffle over all documents.

The distribution function of a source is tabulated once, 12 deviations to either side of its
mean, where it rounds to 0 and 1, so a document needs one comparison with a short array.

Defined results: a null source is a source of its own; a null text has no bytes (a source of
such texts only has rate 0).  A null id counts as the empty text; rows with equal ids get
equal numbers of copies.  An empty table gives no row.  Columns of the input are kept as they
are; working columns begin with ``__mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.session import staged

#: Numbers in the table of distributions up to which it is broadcast (8 MB); beyond, it is
#: joined by a shuffle, whose hot sources adaptive execution splits.
BROADCAST_NUMBERS = 1_000_000
#: Terms of a distribution that are summed in one go.
ROW = 128


def uniform(seed: str, *parts: Column) -> Column:
    """52 bits of an md5 as a number from 0 to 1, 1 excluded."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function from 1 on, to 15 digits: Stirling's series at x + 8."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)
    below = x
    for k in range(1, 8):
        below = below * (x + k)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(below)


def poisson_table(rate: Column) -> tuple[Column, Column]:
    """first and cdf: the distribution function at first, first + 1, ...

    The table covers 12 deviations on either side of the mean; beyond, the distribution is 0 or
    1 in doubles.  So its length grows with the root of the rate.  Terms come from the logarithm
    of the gamma function; the sums are a running total, a block of ``ROW`` terms at a time.
    """
    spread = 12 * F.sqrt(rate) + 12
    first = F.greatest(F.floor(rate - spread), F.lit(0)).cast("long")
    last = F.ceil(rate + spread).cast("long")
    log_p = lambda k: k * F.log(rate) - rate - log_gamma(k + 1)
    block = lambda start: F.sequence(start, F.least(start + ROW - 1, last))
    terms = F.transform(F.sequence(first, last, F.lit(ROW).cast("long")), lambda s: F.transform(block(s), lambda k: F.exp(log_p(k.cast("double")))))
    # what the blocks before hold, and the running total inside a block
    totals = F.transform(terms, lambda t: F.aggregate(t, F.lit(0.0), lambda x, y: x + y))
    before = lambda t, i: F.aggregate(F.slice(t, F.lit(1), i), F.lit(0.0), lambda x, y: x + y)
    made = F.transform(F.array(F.struct(terms.alias("terms"), totals.alias("totals"))), lambda m: F.flatten(
        F.transform(m["terms"], lambda t, b: F.transform(t, lambda _, i: before(m["totals"], b) + before(t, i + 1)))
    ))
    return first, F.when(rate > 0, F.element_at(made, 1)).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, weights: dict[str, float] | None, flatten: float, total: float, text: str, source: str) -> DataFrame:
    """Bytes and mean repetition rate of each source, as a table in the shared folder."""
    sizes = docs.groupBy(F.col(source).alias("__mix_source")).agg(
        F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")).alias("__mix_bytes")
    )
    if weights is None:
        want = F.pow(F.col("__mix_bytes").cast("double"), F.lit(flatten))
    else:
        names = [x for name, w in sorted(weights.items()) for x in (F.lit(name), F.lit(float(w)))]
        want = F.coalesce(F.try_element_at(F.create_map(*names), F.col("__mix_source")), F.lit(0.0)) if names else F.lit(0.0)
    has_bytes = F.col("__mix_bytes") > 0
    sizes = staged(sizes.withColumn("__mix_want", F.when(has_bytes, want).otherwise(F.lit(0.0))), "mix-sources")
    wants, everything = sizes.agg(F.sum("__mix_want"), F.sum("__mix_bytes")).first()
    per_want = total * everything / wants if wants else 0.0
    rate = F.when(has_bytes, F.col("__mix_want") * F.lit(float(per_want)) / F.col("__mix_bytes")).otherwise(F.lit(0.0))
    return sizes.select("__mix_source", "__mix_bytes", rate.alias("__mix_rate"))


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, flatten: float = 0.5, total: float = 1.0, seed: str = "mixture",
    key: str = "doc_id", text: str = "text", source: str = "source", carry: list[str] | None = None, partitions: int | None = None,
) -> DataFrame:
    """Copies of ``docs`` in shuffled order: the columns ``carry`` (all by default) and
    ``__mix_copy``, ``__mix_copies`` and ``__mix_order``.

    ``weights`` gives shares by source (others get none); without it a source's share is its
    bytes to the power ``flatten``.  ``total`` is the wanted bytes against the bytes there are.
    """
    spark = docs.sparkSession
    carry = docs.columns if carry is None else carry
    sources = rates(docs, weights, flatten, total, text, source)
    first, cdf = poisson_table(F.col("__mix_rate"))
    table = staged(sources.select("__mix_source", first.alias("__mix_first"), cdf.alias("__mix_cdf")), "mix-tables")
    numbers = table.agg(F.sum(F.size("__mix_cdf"))).first()[0] or 0
    table = F.broadcast(table) if numbers <= BROADCAST_NUMBERS else table
    kept = docs.select(*dict.fromkeys([*carry, key, source]))
    joined = kept.join(table, kept[source].eqNullSafe(table["__mix_source"]))
    draw = uniform(seed, F.col(key))
    # the lambda gets all it needs as its argument: Catalyst pushes filters by the columns outside of lambdas
    own = F.array(F.struct(F.col("__mix_first").alias("first"), F.col("__mix_cdf").alias("cdf"), draw.alias("u")))
    number = F.element_at(F.transform(own, lambda t: t["first"].cast("int") + F.size(F.filter(t["cdf"], lambda c: c <= t["u"]))), 1)
    counted = joined.withColumn("__mix_copies", number)
    copies = counted.where(F.col("__mix_copies") > 0).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("__mix_copy")))
    ordered = copies.withColumn("__mix_order", order).select(*carry, "__mix_copy", "__mix_copies", "__mix_order")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ordered.repartition(n, "__mix_order").sortWithinPartitions("__mix_order")
