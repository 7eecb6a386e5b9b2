import zlib

from pagewright.llm import langid
from pagewright.llm.queries import op1_language_id


def test_held_out_accuracy(spark, sf):
    rows = op1_language_id(spark, sf).collect()
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)


def test_scores_match_a_plain_computation():
    import numpy as np

    model = langid.Model(("a", "b"), np.random.default_rng(0).normal(size=((1 << 8) + 1, 2)).astype(np.float32), np.log([0.4, 0.6]), (1, 2, 3), 8)
    model.log_probability[-1] = 0
    texts = ["abc", "", "x y", "ÄÖ ünd so", "İstanbul"]
    together, scores = langid.predict(texts, model)
    for text, language, score in zip(texts, together, scores, strict=True):
        alone, one = langid.predict([text], model)
        assert alone == [language] and abs(one[0] - score) < 1e-6
        found, _, letters = langid._features([text], model.orders, model.bits)
        total = model.prior + sum(model.log_probability[row].sum(axis=0, dtype=float) for row in found)
        assert language == ("und" if not letters[0] else model.languages[int(total.argmax())])


def test_odd_rows(spark, odd, nothing):
    model = langid.fit(odd, per_language=5)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert by_id[0] == by_id[1] == by_id[2] == by_id[8] == "und" and by_id[4] == "en"
    assert langid.fit(nothing).languages == ()
    assert {r["lang_pred"] for r in langid.identify(odd, langid.fit(nothing)).collect()} == {"und"}
    assert langid.identify(nothing, model).count() == 0
