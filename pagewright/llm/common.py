"""What several of the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(doc_id: str | Column) -> Column:
    """The id as UTF-8 bytes; a null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")


def fold(doc_id: str | Column, folds: int = 4) -> Column:
    """crc32 of the id's text modulo ``folds``."""
    return F.crc32(id_text(doc_id)) % F.lit(folds)


def held_out(doc_id: str | Column) -> Column:
    return fold(doc_id) == F.lit(2)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def raw_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as no bytes."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def runs(texts: list, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters each, so that numpy's scratch arrays
    stay small; a longer text has a range to itself."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > most:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)
