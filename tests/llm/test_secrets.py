import math
import random
import re
import string
from collections import Counter

import pytest

from pagewright.llm import secrets
from pyspark.sql import functions as F


def brute(text):
    """All spans of a text, straight from the definitions."""
    text = text or ""
    base, added = [], []
    for rank, p in enumerate(secrets.PATTERNS):
        for m in re.finditer(p.pattern, text, re.A):
            if len(m.group(p.group)) >= p.least:
                base.append((m.start(), rank, m.end(), p.kind))
    blanked = text
    for word in ("placeholder", "0123456789|123456789a|abcdefghij", "changeme", "example", "sample", "dummy|your[_-]"):
        blanked = re.sub(word, lambda m: " " * len(m.group()), blanked, flags=re.I)
    blanked = re.sub(r"([A-Za-z0-9+/_=-])\1{7}", " " * 8, blanked)
    for rank, c in enumerate(secrets.CLASSES, start=len(secrets.PATTERNS)):
        for m in re.finditer(f"[{c.characters}]{{{c.window},}}", blanked):
            run = m.group()
            if any(re.search(a, run) for a in secrets.ALLOW):
                continue
            run = run.lower() if c.fold else run
            windows = (Counter(run[end - c.window : end]).values() for end in range(c.window, len(run) + 1))
            if any(-sum(n / c.window * math.log2(n / c.window) for n in counts) > c.bits for counts in windows):
                added.append((m.start(), rank, m.end(), c.kind))
    added = [a for a in added if not any(b[0] <= a[0] and a[2] <= b[2] for b in base)]
    joined = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    return joined(base), joined(base + added)


def test_allowed_parts_hide_nothing_beside_them(spark):
    draw = random.Random(8)
    key = "".join(draw.choice(string.ascii_letters + string.digits) for _ in range(40))
    texts = [f"A {x}" for x in (key, "AAAAAAAA" + key, key + "/example", "x/sample_keys/" + key, "example" * 6, "your_key_0123456789_placeholder")]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.scan(rows).withColumn("clean", secrets.redacted("text", "__secret_spans")).orderBy("doc_id").collect()
    for r in found[:4]:
        assert r["__secret_spans"] and key[:20] not in r["clean"] and key[-4:] not in r["clean"] and key[:4] not in r["clean"]
    assert [r["clean"] for r in found[4:]] == texts[4:]


def samples():
    draw = random.Random(5)
    key = lambda n, letters: "".join(draw.choice(letters) for _ in range(n))
    base64, hexes = string.ascii_letters + string.digits + "+/", "0123456789abcdef"
    texts = [None, "", "password = hunter2", 'api_key="abcdefgh123"', 'secret:apikey="longsecret123"', "TOKEN: " + key(30, base64), "AKIA" + key(16, "ABCDEF0123"), "AKIA", "xAKIAAKIAAKIA" + "0" * 9]
    texts += [f"é {key(n, hexes)} ß {key(n, base64)}." for n in (19, 20, 31, 32, 40, 90)]
    texts += ["550e8400-e29b-41d4-a716-446655440000", "a" * 40, "0123456789abcdef0123", "internationalisationofthewords", "1" * 30, "example" + key(30, base64), key(25, base64) + "a" * 40 + key(25, base64)]
    return texts + ["token=" + key(400, base64) + " " + key(3000, base64), "password: x " * 2000]


def test_spans_match_brute_force(spark):
    texts = samples()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.scan(rows).select("doc_id", secrets.listed("__secret_base").alias("base"), secrets.listed("__secret_spans").alias("spans")).collect()
    for r in found:
        assert (r["base"], r["spans"]) == brute(texts[r["doc_id"]]), texts[r["doc_id"]]
    assert any("entropy_base64" in r["spans"] for r in found) and any("entropy_hex" in r["spans"] for r in found)


@pytest.mark.parametrize(
    "spans, expected",
    [
        ([(3, 0, 6)], "abc[SECRET]ghij"), ([(0, 0, 2), (1, 1, 4)], "[SECRET]efghij"), ([], "abcdefghij"), ([(8, 0, 10)], "abcdefgh[SECRET]"),
        ([(0, 0, 5), (1, 1, 3), (6, 0, 7)], "[SECRET]f[SECRET]hij"),
    ],
)
def test_redaction(spark, spans, expected):
    rows = spark.createDataFrame([("abcdefghij", [(a, r, b, "k") for a, r, b in spans])], f"text string, s array<{secrets.SPAN}>")
    assert rows.select(secrets.redacted("text", "s")).first()[0] == expected


def test_odd_rows(spark, odd, nothing):
    found = secrets.scan(odd)
    assert found.count() == odd.count() and set(odd.columns) <= set(found.columns)
    assert found.where("doc_id = 0").select(F.size("__secret_spans")).first()[0] == 0
    assert secrets.scan(nothing).count() == 0


def test_plan_stays_in_the_engine(odd, capsys):
    secrets.scan(odd).explain()
    assert "Python" not in capsys.readouterr().out
