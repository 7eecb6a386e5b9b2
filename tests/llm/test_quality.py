from pagewright.llm import quality


def test_clean_and_repetitive_texts():
    clean = " ".join(f"word{i}" for i in range(120))
    assert quality.measure(clean)[5:7] == (False, True)
    line = "one two three four five six seven eight nine ten"
    repeated = "\n".join([clean, *[line] * 10])
    n_words, chars, symbols, lines, repeat, failed, kept, grams, shares = quality.measure(repeated)
    assert (n_words, lines, repeat, failed, kept) == (220, 9, 100, False, False) and grams > 0.15 and shares > 0.2
    assert quality.measure("a b c " * 40)[5] is True and quality.measure("a b")[5:7] == (True, False)


def test_rolling_windows_match_a_plain_count():
    words = "a b c d e f a b c d e g a b c d e f x y".split()
    share = quality.measure(" ".join(words), {5: 1.0})[7]
    seen, covered = set(), set()
    for i in range(len(words) - 4):
        gram = tuple(words[i : i + 5])
        covered |= set(range(i, i + 5)) if gram in seen else set()
        seen.add(gram)
    assert abs(share - len(covered) / len(words)) < 1e-12


def test_odd_rows(spark, odd, odd_rows, nothing):
    rows = quality.assess(odd).collect()
    assert len(rows) == len(odd_rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert tuple(by_id[0])[1:8] == (0, 0, 0, 0, 0, True, False) == tuple(by_id[1])[1:8] == tuple(by_id[2])[1:8]
    assert by_id[8]["n_symbols"] == 6 and by_id[6]["n_words"] == 60_000 and by_id[9]["n_words"] == 1
    assert quality.assess(nothing).count() == 0
