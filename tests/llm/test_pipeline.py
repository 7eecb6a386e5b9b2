import corpus_pipeline
from pagewright.llm import jaccard, mixing, secrets, toxicity
from pagewright.llm.common import held_out
from tests.llm.test_jaccard import brute
from tests.llm.test_secrets import brute as brute_spans


def test_stages_against_plain_versions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        rows = after.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
            now = {r["doc_id"]: r["text"] for r in rows}
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet").where(~held_out("doc_id")))
            keys = sorted(before)
            scores = toxicity.Scorer(model).score([before[k] for k in keys])
            assert set(now) == {k for k, s in zip(keys, scores, strict=True) if s < 0.3} and 0 < len(now) < len(before)
        elif name == "ngram_jaccard_join":
            assert set(now) == {c for _, c in brute(before.items(), 5, 80).values()}
        elif name == "secret_scans":
            assert set(now) == set(before)
            for key, text in now.items():
                spans = brute_spans(before[key])[1]
                assert (text != before[key]) == bool(spans) and text.count("[SECRET]") <= max(1, spans.count(",") + 1)
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "source_mixing":
            assert set(now) <= set(before) and all(before[r["doc_id"]] == r["text"] for r in rows)
        else:
            assert {r["doc_id"] for r in rows} == set(before)
        before, docs = now, after


def test_run(spark, sf):
    found = corpus_pipeline.run(spark, sf)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and not found.isEmpty()


def test_stage_names():
    assert len(corpus_pipeline.STAGES) == 5 and all(callable(f) for _, f in corpus_pipeline.STAGES)
    assert jaccard and mixing and secrets


def test_stages_on_odd_and_empty_tables(spark, sf, odd, nothing):
    """Nulls, repeated rows and clashing columns pass every stage; empty tables stay empty."""
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, odd, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert rows.columns == odd.columns
        found = rows.collect()
        ids = {r["doc_id"] for r in odd.collect()}
        assert {r["doc_id"] for r in found} <= ids and found
        if name in ("toxicity", "secret_scans"):
            assert len(found) == odd.count()
        if name == "ngram_jaccard_join":
            kept = [r["doc_id"] for r in found]
            assert len(kept) == len(set(kept)) and {0, 1, 2, 4, None} <= set(kept) and not {5, 100} & set(kept)
        assert stage(spark, nothing, sf).count() == 0
