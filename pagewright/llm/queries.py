"""One query for each operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import htmltext, jaccard, langid, mixing, packing, quality, secrets, sharding, sql, topk, toxicity
from pagewright.llm.common import documents, held_out

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "byte_bpe_50k.json"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("__held_out", held_out("doc_id"))
    model = langid.fit(docs.where(~docs["__held_out"]))
    found = langid.identify(docs, model, keep=("doc_id", "__held_out"))
    return found.select("doc_id", found["__held_out"].alias("held_out"), "lang_pred", "score")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text")).withColumn("spans", secrets.listed("__secret_spans"))
    counts = [secrets.count_of("__secret_base", p.kind).alias(f"n_{p.kind}") for p in secrets.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(secrets.listed("__secret_base"), 256).alias("base_sha256"), "spans")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.by_bytes(documents(spark, sf_dir), shards=8)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of the mixture: its document, number and place in the shuffled order."""
    mixed = mixing.mix(documents(spark, sf_dir), carry=["doc_id", "source"])
    return mixed.select("doc_id", "source", F.col("__mix_copy").alias("copy"), F.col("__mix_copies").alias("copies"), F.col("__mix_order").alias("shuffle_key"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(documents(spark, sf_dir))
    return found.drop("dup_ngram_share", "dup_line_share")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.fit(documents(spark, sf_dir), labels.where(~held_out("doc_id")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("__held_out", held_out("doc_id"))
    found = toxicity.score(docs, toxicity_model(spark, sf_dir), keep=("doc_id", "__held_out"), threshold=0.3)
    return found.select("doc_id", F.col("__held_out").alias("held_out"), "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.group(documents(spark, sf_dir), jaccard.Rule(n=3, percent=90))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_language_id, op2_secret_scan, op3_sharding, op4_exact_top_k, op5_source_mix, op6_quality_rules, op7_main_text, op8_toxicity, op9_packing, op10_ngram_jaccard)
}
ORACLE_SQL: dict[str, str] = dict(sql.ORACLE_SQL)
