import random
import re

import numpy as np
import pytest

from pagewright.llm import jaccard


def brute(rows, n=3, percent=90):
    """doc_id to (set size, component) by comparing all pairs."""
    sets = {}
    for key, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        sets[key] = own
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in keys}


def edited(draw, words, n):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def corpus():
    draw = random.Random(11)
    word = lambda: f"w{draw.randrange(400)}"
    texts = []
    base = [word() for _ in range(150)]
    texts += [edited(draw, base, draw.randint(0, 4)) for _ in range(90)]  # one large group of near copies
    texts += [" ".join(base)] * 20
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(60)]  # a shared passage
    for _ in range(30):
        own = [word() for _ in range(draw.randint(3, 90))]
        texts += [edited(draw, own, draw.randint(0, 2)) for _ in range(draw.randint(1, 3))]
    texts += ["A b C", "a B c", "one", "ONE", "two words", None, "", " \n "]
    order = list(range(len(texts)))
    draw.shuffle(order)
    return [(k, texts[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize("rule, settings", [((3, 90), {}), ((3, 90), {"small_group": 4, "block": 10}), ((5, 80), {"small_group": 8, "block": 1000})])
def test_components_match_all_pairs(spark, rule, settings):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.group(docs, jaccard.Rule(*rule), **settings).collect()}
    assert found == brute(rows, *rule)


def boilerplate(draw, n):
    """Documents of their own words around one long passage, and a few near copies of some of them."""
    passage = " ".join(f"license{i}" for i in range(120))
    texts = []
    for i in range(n):
        own = [f"w{draw.randrange(30_000)}" for _ in range(draw.randint(12, 60))]
        texts.append(passage + " " + " ".join(own))
        if i % 50 == 0:
            own[3] = "changed"
            texts.append(passage + " " + " ".join(own))
    return list(enumerate(texts))


def test_a_passage_of_many_documents(spark, monkeypatch):
    """The pairs that are made stay in proportion to the documents that share a passage."""
    made = {}
    keep = jaccard.staged

    def counted(df, name):
        found = keep(df, name)
        if name == "pairs":
            made["pairs"] = made.get("pairs", 0) + found.count()
        return found

    monkeypatch.setattr(jaccard, "staged", counted)
    rows = boilerplate(random.Random(5), 5000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in jaccard.group(docs).collect()}
    small = boilerplate(random.Random(5), 300)
    assert {k: found[k] for k, _ in small if found[k] < len(small)} == {k: c for k, (_, c) in brute(small).items()}
    assert made["pairs"] < 4 * len(rows)


def test_bitmap_differs_in_no_more_bits_than_sets_in_tokens():
    draw = np.random.default_rng(3)
    for _ in range(50):
        both, a, b = (draw.integers(0, 2**63, draw.integers(0, 300), dtype=np.uint64) for _ in range(3))
        x, y = (jaccard.bitmap(np.concatenate([both, own])) for own in (a, b))
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(a) + len(b)


@pytest.mark.parametrize("settings", [{}, {"broadcast_ids": 0}])
def test_one_of_each(spark, settings):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in jaccard.one_of_each(docs.union(docs.limit(5)), jaccard.Rule(5, 80), **settings).collect())
    assert kept == sorted({c for _, c in brute(rows, 5, 80).values()})


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["component"] for r in jaccard.components(links).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_odd_rows(spark, odd, odd_rows, nothing):
    rows = jaccard.group(odd).collect()
    assert len(rows) == len(odd_rows)
    by_id = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert by_id[0] == (0, 0) and by_id[1] == (0, 1) and by_id[5] == (1, 4) and by_id[100] == (1, 4) and by_id[None] == (1, None)
    assert jaccard.one_of_each(odd).columns == odd.columns
    assert jaccard.group(nothing).count() == 0 and jaccard.one_of_each(nothing).count() == 0
