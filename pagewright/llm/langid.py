"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fitting counts hashed n-grams per language on a bounded sample of labelled rows
(``per_language`` documents of each of at most ``languages`` languages, whole texts).  The
smoothed log-probability matrix, ``2**bits`` features by languages, is broadcast.  Scoring
turns a run of documents into one long array of feature numbers and adds up matrix rows per
document, which is the product of a sparse count matrix with the dense log-probabilities.

Defined results: a null text or one without a letter gives ``und`` with score 0; with no
labelled row at all everything is ``und``.  Equal texts give equal predictions; a tie goes to
the language that sorts first.  Only the id and text columns are read, so other columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import runs, strings

#: An odd multiplier for each place of an n-gram.
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)
SPACE = 32


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: features + 1 rows (the last is zero) by languages
    log_probability: np.ndarray
    prior: np.ndarray
    orders: tuple[int, ...]
    bits: int


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Every code point as itself if it is a letter and as a space if not."""
    return np.array([c if chr(c).isalpha() else SPACE for c in range(0x110000)], dtype=np.uint32)


def _features(texts: list[str], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers (orders by positions), where each text starts and its number of letters.

    Each text is followed by enough spaces to keep n-grams from reaching into the next one;
    n-grams that start there get the number ``2**bits``.
    """
    gap = max(orders)
    joined = (" " * gap).join([*texts, ""]).lower()
    if len(joined) != sum(map(len, texts)) + gap * len(texts):  # a letter whose lower case is longer
        texts = [t.lower() for t in texts]
        joined = (" " * gap).join([*texts, ""])
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths + gap)[:-1]))
    is_letter = codes != SPACE
    n_letters = np.add.reduceat(is_letter, starts, dtype=np.int64) if len(codes) else np.zeros(len(texts), np.int64)
    outside = np.zeros(len(codes) + 1, dtype=np.int32)
    np.add.at(outside, starts + lengths, 1)
    np.add.at(outside, starts + lengths + gap, -1)
    outside = np.cumsum(outside[:-1]) > 0
    found = np.empty((len(orders), len(codes)), dtype=np.int64)
    for row, order in enumerate(orders):
        key = np.full(len(codes), order * 0x9E3779B9 & 0xFFFFFFFF, dtype=np.uint32)
        for place in range(order):
            key[: len(codes) - place] += codes[place:] * MULTIPLIERS[place]
            key ^= key >> np.uint32(15)
            key *= np.uint32(0x2C1B3C6D)
        found[row] = key >> np.uint32(32 - bits)
        found[row][outside] = 1 << bits
    return found, starts, n_letters


def _counted(batches: Iterator[pa.RecordBatch], text: str, label: str, orders, bits) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    n: dict[str, int] = {}
    for batch in batches:
        texts, labels = strings(batch, text), batch.column(label).to_pylist()
        for a, b in runs(texts, 1 << 20):
            for language in set(labels[a:b]):
                own = [t for t, x in zip(texts[a:b], labels[a:b], strict=True) if x == language]
                found, _, _ = _features(own, orders, bits)
                total = np.bincount(found.ravel(), minlength=(1 << bits) + 1)[: 1 << bits]
                counts[language] = counts.get(language, 0) + total
                n[language] = n.get(language, 0) + len(own)
    names = sorted(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([n[x] for x in names], pa.int64()), pa.array([counts[x].astype("<f4").tobytes() for x in names], pa.binary())],
        names=["language", "n", "counts"],
    )


def fit(
    labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = 1500, languages: int = 256,
    orders: tuple[int, ...] = (1, 2, 3), bits: int = 16, smoothing: float = 0.5, workers: int = 8,
) -> Model:
    """Fit on about ``per_language`` rows of each of the ``languages`` most frequent labels.

    The sample is by a hash of ``key``: a row is in it whatever the partitioning is.
    """
    labelled = labelled.where(F.col(label).isNotNull())
    sizes = labelled.groupBy(F.col(label).alias("language")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(languages).collect()
    if not sizes:
        return Model((), np.zeros(((1 << bits) + 1, 0), np.float32), np.zeros(0), orders, bits)
    share = F.create_map(*[x for row in sizes for x in (F.lit(row["language"]), F.lit(min(1.0, per_language / row["n"])))])
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.where(draw < share[F.col(label)]).select(F.col(text).alias("text"), F.col(label).alias("label")).repartition(workers)
    parts = sample.mapInArrow(lambda it: _counted(it, "text", "label", orders, bits), "language string, n long, counts binary").collect()
    names = tuple(sorted({p["language"] for p in parts}))
    counts, n = np.zeros((1 << bits, len(names))), np.zeros(len(names))
    for p in parts:
        counts[:, names.index(p["language"])] += np.frombuffer(p["counts"], "<f4")
        n[names.index(p["language"])] += p["n"]
    counts += smoothing
    table = np.zeros(((1 << bits) + 1, len(names)), np.float32)
    table[:-1] = np.log(counts / counts.sum(axis=0))
    return Model(names, table, np.log(n / n.sum()) if len(names) else n, orders, bits)


def predict(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and its posterior probability for each text."""
    languages, scores = ["und"] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return languages, scores
    for a, b in runs(texts, 1 << 20):
        found, starts, n_letters = _features(texts[a:b], model.orders, model.bits)
        total = np.tile(model.prior, (b - a, 1))
        for row in found:
            for k in range(len(model.languages)):
                total[:, k] += np.add.reduceat(model.log_probability[:, k][row], starts, dtype=np.float64)
        best = total.argmax(axis=1)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        top = 1 / odds.sum(axis=1)
        for i in np.flatnonzero(n_letters):
            languages[a + i], scores[a + i] = model.languages[best[i]], min(1.0, top[i])
    return languages, scores


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` for every row of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    inputs = docs.select(*keep, F.col(text).alias("__text"))
    fields = [f for f in inputs.schema.fields if f.name != "__text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string", "score double"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores = predict(strings(batch, "__text"), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in fields), pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                names=[*(f.name for f in fields), "lang_pred", "score"],
            )

    return inputs.mapInArrow(scored, schema)
