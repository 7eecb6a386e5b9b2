import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(f"word{i % 977} thing{i % 31}" for i in range(30_000))
    texts = [None, "", " \n\t", "a", "the cat sat", "the cat sat", long_text, "ünïcödé ßtraße 東京 " * 50, "!!! ### $$$", "x" * 50_000, "\x00\x1f odd   spaces\xa0here"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "src0", None) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, "no id", "en", "src1", 5), (100, "the cat sat", None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with more columns whose names clash with results."""
    return spark.createDataFrame([(*r, "x", 0.5, 1) for r in odd_rows], f"{SCHEMA}, spans string, score double, shard int").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
