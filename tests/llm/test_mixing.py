import math

from pagewright.llm import mixing
from pyspark.sql import functions as F


def test_counts_follow_the_poisson_distribution(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abcdefghij").alias("text"), F.when(F.col("id") < 3000, "big").otherwise("small").alias("source"))
    mixed = mixing.mix(docs, weights={"big": 1, "small": 1})
    sizes = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(sizes["big"] - 2000) < 150 and abs(sizes["small"] - 2000) < 150
    rate = 2000 / 3000
    kept = mixed.where("source = 'big'").groupBy("doc_id").count().groupBy("count").agg(F.count("*").alias("n")).collect()
    for r in kept:
        expected = 3000 * math.exp(-rate) * rate ** r["count"] / math.factorial(r["count"])
        assert abs(r["n"] - expected) < 5 * math.sqrt(expected) + 5
    orders = [r["__mix_order"] for r in mixed.collect()]
    assert len(set(orders)) == len(orders)


def table(spark, rate):
    return tuple(spark.range(1).select(*mixing.poisson_table(F.lit(rate))).first())


def test_inverse_is_exact(spark):
    for rate in (0.01, 2.5, 90.0, 700.0):
        first, cdf = table(spark, rate)
        total, exact = 0.0, {}
        for k in range(first + len(cdf)):
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            exact[k] = total
        assert all(abs(value - exact[first + i]) < 1e-11 for i, value in enumerate(cdf)) and first + len(cdf) > rate


def test_table_of_a_large_rate_is_short(spark):
    first, cdf = table(spark, 1e6)
    assert len(cdf) < 25 * 1000 and cdf[0] < 1e-20 and abs(cdf[-1] - 1) < 1e-8
    half = first + sum(c <= 0.5 for c in cdf)
    assert abs(half - 1e6) < 3


def test_one_document_of_a_rare_source_is_repeated(spark):
    rows = [(0, "short text", "rare")] + [(i, "longer text of the large source " * 40, "large") for i in range(1, 3001)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), flatten=0.0)
    n = mixed.where("source = 'rare'").count()
    rate = (10 + 3000 * 1280) / 2 / 10
    assert abs(n - rate) < 6 * math.sqrt(rate)


def test_same_copies_whatever_the_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, two = (sorted((r["doc_id"], r["__mix_copy"], r["__mix_order"]) for r in mixing.mix(d, carry=["doc_id"]).collect()) for d in (docs, docs.repartition(7)))
    assert one == two


def test_odd_rows(spark, odd, nothing):
    rows = mixing.mix(odd, total=3.0).collect()
    assert rows and set(odd.columns) <= set(rows[0].asDict())
    assert mixing.mix(odd, weights={}).count() == 0 and mixing.mix(nothing).count() == 0


def test_plan_stays_in_the_engine(odd, capsys):
    mixing.mix(odd).explain()
    assert "Python" not in capsys.readouterr().out
