"""Quality rules by repetition coverage.

For each of several n-gram lengths a rolling hash runs over the document's word numbers in
numpy; the characters of all words inside an n-gram that has occurred before are measured
against the characters in words, and so are the characters of lines that repeat an earlier
line.  A document is rejected by the method where one of these shares is over its limit, and
by the base rules where it has under ``least_words`` words or over half of its words stand in
repeated three-word windows.

Defined results: a null or empty text has no words, so it fails the base rules with zero
counts.  Words are maximal runs without U+0020 and U+0009 to U+000D.  Whole texts of any
length are measured; equal rows give equal results.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The largest share of word characters inside duplicated n-grams, by n-gram length.
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: The largest share of characters in lines that repeat an earlier line.
LINE_LIMIT = 0.20
SYMBOLS = "#*$%&|<>"
BREAKS = " \t\n\x0b\x0c\r"
BASE = np.uint64(0x9E3779B97F4A7C15)
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_ngram_share double, dup_line_share double"


def _covered(keys: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Which words lie in a window of ``n`` words whose key occurs twice or more; without
    ``first``, the earliest window of each key does not count."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return np.zeros(len(keys) + n - 1, dtype=bool)
    twice = np.zeros(len(keys), dtype=bool)
    twice[1:] = same
    if first:
        twice[:-1] |= same
    edges = np.zeros(len(keys) + n, dtype=np.int64)
    starts = order[twice]
    edges[starts] += 1
    edges[starts + n] -= 1
    return np.cumsum(edges)[:-1] > 0


def measure(text: str, limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT, least_words: int = 50) -> tuple:
    """The values of ``COLUMNS`` for one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n_words = len(words)
    word_chars = len(text) - sum(text.count(c) for c in BREAKS)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_dup_lines = len(lines) - len(set(lines))
    line_share = 0.0
    if n_dup_lines:
        seen: set[bytes] = set()
        repeated = total = 0
        for line in lines:
            total += len(line)
            if line in seen:
                repeated += len(line)
            seen.add(line)
        line_share = repeated / total
    n_repeat, worst, over = 0, 0.0, line_share > line_limit
    if n_words >= 3:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n_words)
        if len(numbers) < n_words:
            m = len(numbers)
            pairs = ids[:-1] * m + ids[1:]  # a text has fewer than 2**31 words, so this is exact
            _, pairs = np.unique(pairs, return_inverse=True)
            n_repeat = int(_covered(pairs[:-1] * m + ids[2:], 3, first=True).sum())
            chars = None
            mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            rolled = mixed[:]
            length = 1
            for n in sorted(limits):
                if n > n_words:
                    break
                while length < n:  # hash(w1..wn) = hash(w1..wn-1) * base + wn
                    rolled = rolled[:-1] * BASE + mixed[length:]
                    length += 1
                inside = _covered(rolled, n, first=False)
                if inside.any():
                    if chars is None:
                        chars = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), dtype=np.int64, count=n_words)
                    share = float(chars[inside].sum()) / word_chars
                    worst, over = max(worst, share), over or share > limits[n]
    failed = n_words < least_words or 100 * n_repeat > 50 * n_words
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat, failed, not failed and not over, worst, line_share


def assess(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT, least_words: int = 50) -> DataFrame:
    """The columns ``keep`` and ``COLUMNS`` for every row of ``docs``."""
    inputs = docs.select(*keep, F.col(text).alias("__text"))
    fields = [f for f in inputs.schema.fields if f.name != "__text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), COLUMNS])
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(x or "", limits, line_limit, least_words) for x in batch.column("__text").to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in fields), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                names=[*(f.name for f in fields), *names],
            )

    return inputs.mapInArrow(measured, schema)
