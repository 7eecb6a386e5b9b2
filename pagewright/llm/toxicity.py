"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input joins a learned vector of the word (for words frequent in the training sample)
with the mean of learned vectors of its hashed character trigrams, so unseen spellings have
an input too.  Two gated recurrent layers read a window of words from either end, attention
weighs their joined states, and a logistic unit scores the weighted sum.  A document is read
in overlapping windows, each half a window after the last, over its whole text; its score is
the highest of its windows'.

Training learns from labels of whole documents: in each step the current best window of every
document of a batch is found, and the gradient of the loss goes through that window.  It runs
on the driver over a sample bounded by ``per_class`` rows of each class and ``most_chars``
characters a row, drawn by a hash of the key, with equal texts of a class taken once.

Defined results: a null or empty text is scored by one empty window.  Equal texts have equal
scores.  With labels of one class only, every score is 0 or 1 as that class is; without any
label it is 0.  Only the id, text and label columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import runs, strings
from pagewright.session import bounded_batches

MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…“”‘’«»¡¿–—"
#: About what the words that a task remembers, and their projected inputs, may take.
CACHE_BYTES = 40_000_000
#: Of a remembered word, beside its inputs: its object and its place in a dictionary.
WORD_BYTES = 180


@dataclass(frozen=True)
class Shape:
    word: int = 8
    chars: int = 8
    hidden: int = 8
    attention: int = 8
    buckets: int = 4096
    window: int = 32


@dataclass
class Model:
    shape: Shape
    vocabulary: dict[str, int]
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    #: the score of every text where there was only one class to learn
    constant: float | None = None


def normal(word: str) -> str:
    return word.lower().strip(MARKS)


def trigrams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the trigrams of ``^word$``, and where each word's begin."""
    joined = "".join([f"^{w}$" for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    key = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key[:-1] += codes[1:].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    key[:-2] += codes[2:].astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    number = ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % buckets
    inside = np.ones(len(codes), dtype=bool)
    ends = starts + lengths
    inside[ends - 1] = False
    inside[ends[lengths > 2] - 2] = False
    return number[inside], np.concatenate(([0], np.cumsum(np.maximum(lengths - 2, 1))[:-1])).astype(np.int64)


def inputs(words: list[str], model: Model) -> np.ndarray:
    """Word and character vectors of normalised words."""
    w = model.weights
    own = w["word"][np.array([model.vocabulary.get(x, 0) for x in words], dtype=np.int64)]
    number, starts = trigrams(words, model.shape.buckets)
    n = np.diff(np.append(starts, len(number)))
    return np.concatenate([own, np.add.reduceat(w["chars"][number], starts, axis=0) / n[:, None]], axis=1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(projected: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], keep: bool = False):
    """Logits of windows from their projected inputs (windows, steps, 2, 3 * hidden).

    ``mask`` (windows, steps) is 1 at words.  Direction 0 reads from the left, 1 from the right.
    """
    n, steps, _, triple = projected.shape
    h = triple // 3
    state = np.zeros((2, n, h), np.float32)
    states = np.zeros((steps, 2, n, h), np.float32)
    saved = []
    for t in range(steps):
        x = np.stack([projected[:, t, 0], projected[:, steps - 1 - t, 1]])
        on = np.stack([mask[:, t], mask[:, steps - 1 - t]])[:, :, None]
        u = state @ w["recurrent"]
        gates = sigmoid(x[:, :, : 2 * h] + u[:, :, : 2 * h])
        z, r = gates[:, :, :h], gates[:, :, h:]
        new = np.tanh(x[:, :, 2 * h :] + r * u[:, :, 2 * h :])
        after = state + on * (1 - z) * (new - state)
        if keep:
            saved.append((state, z, r, new, u[:, :, 2 * h :], on))
        state = after
        states[t, 0] = state[0]
        states[steps - 1 - t, 1] = state[1]
    joined = np.concatenate([states[:, 0], states[:, 1]], axis=2)  # steps, windows, 2 * hidden
    inner = np.tanh(joined @ w["attend"] + w["attend_bias"])
    weight = np.where(mask.T > 0, inner @ w["attend_out"], -1e9)
    weight = np.exp(weight - weight.max(axis=0)) * mask.T
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    context = (weight[:, :, None] * joined).sum(axis=0)
    logit = context @ w["out"] + w["bias"][0]
    return (logit, saved, joined, inner, weight, context) if keep else logit


def backward(grad: np.ndarray, kept, mask: np.ndarray, w: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the weights and of the projected inputs, from those of the logits."""
    _, saved, joined, inner, weight, context = kept
    steps, n, double = joined.shape
    h = double // 2
    g = {"out": context.T @ grad, "bias": np.array([grad.sum()], np.float32)}
    d_context = grad[:, None] * w["out"]
    d_weight = (joined * d_context).sum(axis=2)
    d_joined = weight[:, :, None] * d_context
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["attend_out"] = np.tensordot(d_score, inner, axes=((0, 1), (0, 1)))
    d_inner = d_score[:, :, None] * w["attend_out"] * (1 - inner**2)
    g["attend"] = np.tensordot(joined, d_inner, axes=((0, 1), (0, 1)))
    g["attend_bias"] = d_inner.sum(axis=(0, 1))
    d_joined += d_inner @ w["attend"].T
    d_states = np.stack([d_joined[:, :, :h], d_joined[:, :, h:]], axis=1)
    d_projected = np.zeros((n, steps, 2, 3 * h), np.float32)
    g["recurrent"] = np.zeros_like(w["recurrent"])
    d_state = np.zeros((2, n, h), np.float32)
    for t in range(steps - 1, -1, -1):
        before, z, r, new, u, on = saved[t]
        d_state[0] += d_states[t, 0]
        d_state[1] += d_states[steps - 1 - t, 1]
        d_after = on * d_state
        d_new = d_after * (1 - z) * (1 - new**2)
        d_z = d_after * (before - new) * z * (1 - z)
        d_r = d_new * u * r * (1 - r)
        d_x = np.concatenate([d_z, d_r, d_new], axis=2)
        d_u = np.concatenate([d_z, d_r, d_new * r], axis=2)
        g["recurrent"] += before.transpose(0, 2, 1) @ d_u
        d_state = d_state - d_after * (1 - z) + d_u @ w["recurrent"].transpose(0, 2, 1)
        d_projected[:, t, 0] = d_x[0]
        d_projected[:, steps - 1 - t, 1] = d_x[1]
    return g, d_projected


def windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Overlapping windows of word numbers, -1 past the end; one empty window for no words."""
    step = size // 2
    n = max(1, -(-(len(ids) - step) // step))
    padded = np.full((n + 1) * step, -1, dtype=np.int64)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::step]


def initial(shape: Shape, n_words: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    h, d = shape.hidden, shape.word + shape.chars
    draw = lambda *size, scale: rng.normal(0, scale, size).astype(np.float32)
    word = draw(n_words + 1, shape.word, scale=0.1)
    word[0] = 0
    return {
        "word": word,
        "chars": draw(shape.buckets, shape.chars, scale=0.3),
        "project": draw(2, d, 3 * h, scale=d**-0.5),
        "project_bias": np.zeros((2, 3 * h), np.float32),
        "recurrent": draw(2, h, 3 * h, scale=h**-0.5),
        "attend": draw(2 * h, shape.attention, scale=(2 * h) ** -0.5),
        "attend_bias": np.zeros(shape.attention, np.float32),
        "attend_out": draw(shape.attention, scale=0.5),
        "out": draw(2 * h, scale=0.5),
        "bias": np.zeros(1, np.float32),
    }


def train(texts: list[str], labels: list[int], shape: Shape = Shape(), epochs: int = 6, least_steps: int = 240, batch: int = 48, rate: float = 0.01, least: int = 4, seed: int = 7) -> Model:
    """Fit a model in ``epochs`` passes, or more where these have under ``least_steps`` steps.

    The same rows in the same order give the same model.
    """
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return Model(shape, {}, constant=float(y[0]) if len(y) else 0.0)
    split = [[normal(x) for x in t.split()] for t in texts]
    seen = [Counter(), Counter()]
    for words, label in zip(split, labels, strict=True):
        seen[label].update(set(words))
    frequent = sorted(x for x in seen[0].keys() | seen[1].keys() if seen[0][x] + seen[1][x] >= least)
    model = Model(shape, {x: i for i, x in enumerate(frequent, start=1)})
    rng = np.random.default_rng(seed)
    w = model.weights = initial(shape, len(frequent), rng)
    # the first place of a word's vector starts from the word's smoothed log-odds of the classes
    one, zero = (np.array([s[x] for x in frequent]) for s in (seen[1], seen[0]))
    w["word"][1:, 0] = np.clip(np.log((one + 0.5) / (y.sum() + 1)) - np.log((zero + 0.5) / (len(y) - y.sum() + 1)), -2, 2) / 2
    everything = sorted({x for words in split for x in words})
    number = {x: i for i, x in enumerate(everything)}
    of_word = np.array([model.vocabulary.get(x, 0) for x in everything], dtype=np.int64)
    grams, starts = trigrams(everything, shape.buckets)
    ends = np.append(starts[1:], len(grams))
    docs = [windows(np.array([number[x] for x in words], dtype=np.int64), shape.window) for words in split]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step = 0
    width = shape.word

    def project(ids: np.ndarray):
        """Projected inputs of windows, with what the gradient needs."""
        used, at = np.unique(ids, return_inverse=True)
        at = at.reshape(ids.shape)
        real = np.maximum(used, 0)
        n = ends[real] - starts[real]
        rows = np.repeat(np.arange(len(real)), n)
        gram = grams[np.repeat(starts[real] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        x = np.concatenate([w["word"][of_word[real]], np.add.reduceat(w["chars"][gram], np.concatenate(([0], np.cumsum(n)[:-1])), axis=0) / n[:, None]], axis=1)
        table = np.einsum("nd,kdh->nkh", x, w["project"]) + w["project_bias"]
        return table[at].astype(np.float32), (real, at, rows, gram, n, x)

    for _ in range(max(epochs, -(-least_steps // -(-len(docs) // batch)))):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            ids = np.concatenate([docs[i] for i in own])
            of = np.repeat(np.arange(len(own)), [len(docs[i]) for i in own])
            logit = forward(project(ids)[0], (ids >= 0).astype(np.float32), w)
            ranked = np.lexsort((-logit, of))
            best = ids[ranked[np.searchsorted(of[ranked], np.arange(len(own)))]]
            mask = (best >= 0).astype(np.float32)
            projected, (real, at, rows, gram, n, x) = project(best)
            kept = forward(projected, mask, w, keep=True)
            g, d_projected = backward(((sigmoid(kept[0]) - y[own]) / len(own)).astype(np.float32), kept, mask, w)
            d_table = np.zeros((len(real), *d_projected.shape[2:]), np.float32)
            np.add.at(d_table, at, d_projected)
            g["project"] = np.einsum("nd,nkh->kdh", x, d_table)
            g["project_bias"] = d_table.sum(axis=0)
            d_x = np.einsum("nkh,kdh->nd", d_table, w["project"])
            g["word"], g["chars"] = np.zeros_like(w["word"]), np.zeros_like(w["chars"])
            np.add.at(g["word"], of_word[real], d_x[:, :width])
            g["word"][0] = 0
            np.add.at(g["chars"], gram, (d_x[:, width:] / n[:, None])[rows])
            step += 1
            for k, grad in g.items():  # Adam
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad**2 - v)
                w[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


class Scorer:
    """Scores texts with a model; projected inputs of words are remembered."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        w, h = model.weights, model.shape.hidden
        self.table = np.zeros((1024, 2, 3 * h), np.float32)
        self.project = w.get("project")

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) * (WORD_BYTES + self.table[0].nbytes) > CACHE_BYTES:
            self.known.clear()
            self.table = self.table[:1024]
        split, known = [t.split() for t in texts], self.known
        new = list(set().union(*split).difference(known))
        if new:
            w = self.model.weights
            rows = np.einsum("nd,kdh->nkh", inputs([normal(x) for x in new], self.model), w["project"], optimize=True) + w["project_bias"]
            first = len(known)
            if len(self.table) < first + len(new):
                room = np.zeros((max(first + len(new), len(self.table) * 3 // 2) - len(self.table), *self.table.shape[1:]), np.float32)
                self.table = np.concatenate([self.table, room])
            self.table[first : first + len(new)] = rows
            known.update(zip(new, range(first, first + len(new)), strict=True))
        return [np.array(list(map(known.__getitem__, words)), dtype=np.int64) for words in split]

    def score(self, texts: list[str], most: int = 2048) -> np.ndarray:
        """The highest window score of each text."""
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        found = np.zeros(len(texts))
        for a, b in runs(texts, 1 << 19):
            parts = [windows(ids, self.model.shape.window) for ids in self.numbers(texts[a:b])]
            ids = np.concatenate(parts)
            logits = np.empty(len(ids))
            for c in range(0, len(ids), most):
                part = ids[c : c + most]
                logits[c : c + most] = forward(self.table[np.maximum(part, 0)], (part >= 0).astype(np.float32), self.model.weights)
            starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
            found[a:b] = sigmoid(np.maximum.reduceat(logits, starts))
        return found


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 1500, most_chars: int = 20_000, **settings
) -> Model:
    """Train on about ``per_class`` labelled rows of each class."""
    marked = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("__key")).agg(F.max(label).cast("int").alias("__label"))
    usable = docs.where(F.length(text) <= most_chars).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    sizes = {r["__label"]: r["n"] for r in marked.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col("__key").cast("string"), F.lit("toxicity sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("__label") == 1, F.lit(min(1.0, per_class / max(1, sizes.get(1, 0))))).otherwise(F.lit(min(1.0, per_class / max(1, sizes.get(0, 0)))))
    # the sample has about 2 * per_class ids, so it is small enough to broadcast
    sample = F.broadcast(marked.where(draw < share))
    rows = usable.join(sample, "__key").groupBy("__text").agg(F.max("__label").alias("__label"), F.min(F.col("__key")).alias("__key")).collect()
    rows.sort(key=lambda r: (str(r["__key"]), r["__text"]))
    return train([r["__text"] for r in rows], [r["__label"] for r in rows], **settings)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """The columns ``keep`` with ``score`` and ``predicted`` for every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col(text).alias("__text"))
    fields = [f for f in source.schema.fields if f.name != "__text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double", "predicted int"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            s = scorer.score(strings(batch, "__text"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in fields), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                names=[*(f.name for f in fields), "score", "predicted"],
            )

    return source.mapInArrow(scored, schema)


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` under the threshold, with all their columns as they are."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            s = scorer.score([x or "" for x in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(kept, docs.schema)
