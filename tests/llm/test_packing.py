import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagewright.llm import packing
from pagewright.llm.queries import TOKENIZER

PATH = public_tokenizers.path(TOKENIZER)


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def ids(plain, text):
    return np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")


def check(plain, docs, rows, capacity=1024):
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(ids(plain, r["text"]))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == texts.keys()
    for key, copies in texts.items():
        covered = sorted((r["start"], r["length"]) for r in pieces[key])
        assert sum(n for _, n in covered) == sum(map(len, copies))
        for r in pieces[key]:
            assert any(r["doc_tokens"] == len(t) and r["ids_crc32"] == zlib.crc32(t[r["start"] : r["start"] + r["length"]].tobytes()) for t in copies)
        if len(copies) == 1:
            at = 0
            for start, n in covered:
                assert start == at
                at += n
    padding = total = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / total if total else 0


def test_round_trip_and_padding(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    assert check(plain, docs, packing.pack(docs, PATH).collect()) < 0.01


def test_odd_rows(spark, odd, nothing, plain):
    check(plain, odd, packing.pack(odd, PATH).collect())
    assert packing.pack(nothing, PATH).count() == 0


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.one_of(st.text(alphabet=" \n\t\xa0ab'.1é東<|>", max_size=12), st.just("<|endoftext|>")), max_size=6).map("".join), max_size=5))
def test_word_ids_equal_whole_text_ids(plain, texts):
    for text, found in zip(texts, packing.tokenizer(PATH).encode(texts), strict=True):
        assert found == np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_special_names_are_special_tokens(spark, plain):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "a <|endoftext| > b")], "doc_id long, text string")
    check(plain, docs, packing.pack(docs, PATH).collect())
    assert ids(plain, "a <|endoftext|> b").tolist() == [64, 220, 50256, 275, 0]


def test_without_the_fast_encoder_ids_are_the_same(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "tiktoken", None)
    slow = packing.WordTokenizer(PATH)
    assert slow.fast is None
    texts = ["some words, some more", "", "ünïcode  and\nlines "]
    assert slow.encode(texts) == packing.tokenizer(PATH).encode(texts)


def test_word_cache_is_bounded_and_ends_with_the_task(spark, monkeypatch):
    words = packing.WordTokenizer(PATH)
    monkeypatch.setattr(packing, "CACHE_BYTES", 20_000)
    for k in range(20):
        words.encode([" ".join(f"word{k}x{i}" for i in range(50))])
        assert len(words.known) < 200
    words.forget()
    assert not words.known


def test_fast_ranks_are_the_vocabulary():
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    assert packing.fast_encoding(PATH)._mergeable_ranks == ranks
    assert packing.fast_encoding(public_tokenizers.path("word_bpe_49k.json")) is None


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=9, max_codepoint=0x17F), max_size=60), max_size=5))
def test_steady_words_equal_plain_ones(texts):
    words = packing.tokenizer(PATH)
    assert words.encode(texts) == words.plain(texts)


def test_classes_hold_a_fixed_number():
    """Before the tail step, a sequence of class c holds exactly c pieces of that class."""
    packer, draw = packing.Packer(0, 1024, 1 / 64), np.random.default_rng(1)
    for n in range(1, 2000):
        assert sum(packer.lengths(n % 1024)) == n % 1024
    for key in range(4000):
        packer.add(key, bytes(4 * int(draw.integers(1, 1500))))
    closed = defaultdict(list)
    for _, _, length, _, _, sequence, _ in packer.out:
        closed[sequence].append(1024 // length)
    assert len(closed) > 1000
    for held in closed.values():
        assert held == [len(held)] * len(held)
    assert all(len(pieces) < held for held, pieces in packer.open.items())
