"""From raw documents to packed training sequences.

``STAGES`` lists (name, function) pairs; each function takes (spark, docs, sf_dir) and returns
a DataFrame that is written as Parquet and read again as the next stage's ``docs``.  All but
the last keep the columns of documents.  ``run`` applies them to the documents of a folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import jaccard, mixing, packing, secrets, toxicity
from pagewright.llm.common import documents, held_out
from pagewright.session import staged

TOXIC_FROM = 0.3
NEAR = jaccard.Rule(n=5, percent=80)
FLATTEN = 0.5
TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 1024


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model, fitted on the labels outside the held-out fold, scores under the limit."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~held_out("doc_id")))
    return toxicity.accepted(docs, model, threshold=TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates."""
    return jaccard.one_of_each(docs, NEAR)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and the length of the new text."""
    found = secrets.scan(docs).withColumn("__secret_clean", secrets.redacted("text", "__secret_spans"))
    changed = {"text": F.col("__secret_clean"), "n_chars": F.when(F.size("__secret_spans") > 0, F.length("__secret_clean").cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate, in shuffled order."""
    return mixing.mix(docs, flatten=FLATTEN).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), capacity=CAPACITY)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix_sources),
    ("harmonic_packing", pack_sequences),
]

#: No SQL: a trained network and a tokenizer decide; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
