import random
import zlib

import numpy as np

from pagewright.llm import toxicity
from pagewright.llm.queries import op8_toxicity


def corpus(n, seed):
    draw = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = [draw.choice("river stone cloud paper table green seven music light water".split()) for _ in range(draw.randint(5, 120))]
        if i % 3 == 0:
            words.insert(draw.randrange(len(words)), draw.choice(["Idiot!", "moron,", "STUPID"]))
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    shape = toxicity.Shape(hidden=3, attention=2)
    w = {k: v.astype(np.float64) for k, v in toxicity.initial(shape, 2, rng).items()}
    projected = rng.normal(size=(4, 5, 2, 9))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 0, 0, 0], [1, 0, 0, 0, 0], [1, 1, 1, 1, 0]], dtype=float)
    y = np.array([1.0, 0, 1, 0])

    def loss():
        p = toxicity.sigmoid(toxicity.forward(projected, mask, w))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    kept = toxicity.forward(projected, mask, w, keep=True)
    g, d_projected = toxicity.backward(toxicity.sigmoid(kept[0]) - y, kept, mask, w)
    for name in ("recurrent", "attend", "attend_out", "out", "bias", "attend_bias"):
        for at in [tuple(rng.integers(0, n) for n in w[name].shape) for _ in range(4)]:
            w[name][at] += 1e-3
            up = loss()
            w[name][at] -= 2e-3
            down = loss()
            w[name][at] += 1e-3
            assert abs((up - down) / 2e-3 - g[name][at]) < 2e-2 * max(1, abs(g[name][at]))
    projected[0, 2, 1, 4] += 1e-3
    up = loss()
    projected[0, 2, 1, 4] -= 2e-3
    assert abs((up - loss()) / 2e-3 - d_projected[0, 2, 1, 4]) < 2e-2


def test_learns_and_generalises():
    model = toxicity.train(*corpus(300, 1))
    texts, labels = corpus(120, 2)
    score = toxicity.Scorer(model).score(texts)
    assert ((score >= 0.3) == np.array(labels)).mean() > 0.97
    again = toxicity.Scorer(model).score(texts[::-1])[::-1]
    assert np.allclose(score, again, atol=1e-5)


def test_windows_cover_every_word():
    for n in range(0, 100):
        found = toxicity.windows(np.arange(n), 32)
        assert set(found.ravel()) - {-1} == set(range(n)) and found.shape[1] == 32


def test_query_on_held_out_rows(spark, sf):
    rows = op8_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_odd_rows(spark, odd, nothing):
    model = toxicity.train(*corpus(60, 3), least_steps=20)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1, 2)}) == 1
    assert toxicity.accepted(odd, model, threshold=2.0).columns == odd.columns
    assert toxicity.accepted(odd, model, threshold=0.0).count() == 0 and toxicity.score(nothing, model).count() == 0
    labels = spark.createDataFrame([(1, 0), (3, 0), (4, None)], "doc_id long, toxic int")
    assert toxicity.fit(odd, labels).constant == 0.0 and toxicity.fit(nothing, labels).constant == 0.0
