import random

import pytest

from pagewright.operators import filters, frontier, politeness
from pyspark.sql import functions as F


def test_visited_set(spark):
    seen = spark.createDataFrame([("http://example.com",), ("url1",)], "url string")
    urls = spark.createDataFrame([("http://example.com", 1), ("http://example.com/", 2), ("url2", 3), ("url2", 4)], "url string, seq long")
    assert sorted(r["url"] for r in frontier.unvisited(urls, seen).collect()) == ["http://example.com/", "url2", "url2"]
    assert {r["url"]: r["seq"] for r in frontier.first_seen(urls).collect()}["url2"] == 3
    assert frontier.mark_visited(seen, urls).count() == 4
    hits = frontier.in_sketch(urls, frontier.sketch_of(seen)).collect()
    assert "http://example.com" in {r["url"] for r in hits}


def test_few_unheld_urls_pass_the_sketch(spark):
    held, others = (spark.range(a, b).select(F.concat(F.lit("http://h/"), "id").alias("url")) for a, b in ((0, 200_000), (200_000, 210_000)))
    assert frontier.in_sketch(others, frontier.sketch_of(held)).count() <= 200
    assert frontier.in_sketch(held.limit(1000), frontier.sketch_of(held)).count() == 1000


def test_sketch_grows_with_the_urls():
    assert [frontier.sketch_bits(n) for n in (0, 1_000_000, 3_000_000)] == [10_000_000, 10_000_000, 30_000_000]


def test_sketch_shape_and_snapshot(spark, tmp_path):
    assert frontier.sketch_shape(1_000_000, 0.01) == (9_585_059, 7)
    for wrong in ((0, 0.01), (10, 0.0), (10, 1.0)):
        with pytest.raises(ValueError):
            frontier.sketch_shape(*wrong)
    urls = spark.createDataFrame([("u1",), ("u2",)], "url string")
    bits, hashes = frontier.sketch_shape(10, 0.001)
    frontier.save_sketch(frontier.sketch_of(urls, bits, hashes), f"{tmp_path}/sketch", bits, hashes)
    sketch, *shape = frontier.load_sketch(spark, f"{tmp_path}/sketch")
    assert shape == [bits, hashes] and frontier.in_sketch(urls, sketch, hashes, bits).count() == 2


def test_snapshot_counts_every_page_of_a_url(spark, tmp_path):
    from pagewright.plans import catalog

    spark.createDataFrame([(i, f"https://h/{i % 40}", "") for i in range(100)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert catalog.QUERIES["bloom_snapshot"](spark, str(tmp_path)).first().asDict() == {"n": 100, "hits": 100, "few_false": True}


def test_crawl_goes_on_to_the_end(spark):
    from pagewright.operators.crawl import crawl

    pages = spark.createDataFrame([(i, f"https://h/{i}", f'<a href="/{i + 1}">t</a><a href="/0">t</a>') for i in range(5)], "page_id long, url string, html string")
    first = spark.createDataFrame([("h/0",)], "url string")
    assert sorted(tuple(r) for r in crawl(pages, first).collect()) == [(f"https://h/{i}", i) for i in range(6)]
    assert crawl(pages, first, most_steps=2).count() == 2 and crawl(pages, first.limit(0)).count() == 0


def test_queue(spark):
    arrivals = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "url string, seq long")
    assert [r["url"] for r in frontier.bounded(1, arrivals, capacity=3).orderBy("seq").collect()] == ["a", "b"]
    assert frontier.bounded(5, arrivals, capacity=3).count() == 0
    assert [frontier.is_empty(x).first()["is_empty"] for x in (arrivals, arrivals.limit(0))] == [False, True]
    assert [r["url"] for r in frontier.oldest(arrivals, 2).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        frontier.bounded(0, arrivals, capacity=0)


def test_caps_match_one_by_one_processing(spark):
    draw = random.Random(3)
    rows, n0 = [], {d: draw.choice([0, 1, 4, 6, 9]) for d in "abc"}
    for seq in range(300):
        rows.append((seq, draw.choice("abc"), draw.choice([5, 10])))
    counts, expected = dict(n0), []
    for seq, domain, limit in rows:
        if counts[domain] < limit:
            counts[domain] += 1
            expected.append(seq)
    candidates = spark.createDataFrame(rows, "seq long, domain string, visit_limit int")
    visits = spark.createDataFrame(list(n0.items()), "domain string, n long")
    found = frontier.capped(candidates, visits, limit=5)
    assert sorted(r["seq"] for r in found.collect()) == expected


def test_turns(spark):
    links = spark.createDataFrame([(1, "external", 0, "e0"), (1, "internal", 0, "i0"), (1, "internal", 1, "i1"), (1, "internal", 2, "i2")], "page_id long, kind string, pos int, link string")
    assert [r["link"] for r in frontier.interleave(links).orderBy("turn").collect()] == ["i0", "e0", "i1", "i2"]


def test_limits(spark):
    rows = spark.createDataFrame([("a.org",), ("a.com",), ("x.ac.uk",)], "d string")
    found = rows.select(frontier.page_limit(F.col("d")), frontier.domain_limit(F.col("d")), frontier.page_limit(F.col("d"), 1.0)).collect()
    assert [tuple(r) for r in found] == [(40, 200, 4), (20, 100, 2), (40, 200, 4)]


def test_schedule(spark):
    rows = spark.createDataFrame([(i, "h", t) for i, t in enumerate([0, 1, 2, 20])], "id long, host string, at long")
    found = politeness.schedule(rows, 5, "host", F.col("at"), "id", slice_us=2)
    assert [r["access_us"] for r in found.orderBy("id").collect()] == [0, 5, 10, 20]


def test_robots():
    rules, delay = politeness.robots_group("User-agent: *\nDisallow: /p\nAllow: /p/q\nCrawl-delay: 9", "bot")
    assert delay == 5000 and politeness.allowed_by(rules, "/p/q/r") and not politeness.allowed_by(rules, "/p/x")
    assert politeness.robots_group(None, "bot") == ([], 0) and politeness.allowed_by([], "/")


def test_native_robots_rules_match_the_plain_form(spark):
    draw = random.Random(5)
    word = lambda letters, n: "".join(draw.choice(letters) for _ in range(draw.randrange(n)))
    rows = [([(draw.random() < 0.5, "/" + word("ab*.+(é", 5) + draw.choice(["", "$"])) for _ in range(draw.randrange(5))], "/" + word("ab.+(é\n", 6)) for _ in range(400)]
    rows += [([(False, "/")], ""), ([(False, "/")], None), (None, "/a")]
    frame = spark.createDataFrame([(i, r and [(a, p, politeness.pattern_of(p)) for a, p in r], path) for i, (r, path) in enumerate(rows)], "id int, rules array<struct<allow:boolean,path:string,pattern:string>>, path string")
    found = {r[0]: r[1] for r in frame.select("id", politeness.robots_allowed("rules", "path")).collect()}
    assert found == {i: politeness.allowed_by(r or [], path) for i, (r, path) in enumerate(rows)}
    assert len(set(found.values())) == 2


def test_robots_files_join_by_host(spark):
    text = "User-agent: *\nDisallow: /p\nCrawl-delay: 1"
    fetches = spark.createDataFrame([("h", 1, 200, "User-agent: *\nDisallow: /"), ("h", 2, 200, text), ("down", 1, 500, text), ("none", 1, None, None)], "host string, fetched_at long, status int, robots_txt string")
    urls = ["https://h/p/q?x", "http://h:8080/o", "h/p", "down/p", "https://none/p", "https://other/p", None]
    requests = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(urls)], "id int, url string, rules string")
    found = politeness.with_robots(requests, politeness.robots_files(fetches, "bot")).orderBy("id").collect()
    assert [r["robots_allowed"] for r in found] == [False, True, False, True, True, True, True]
    assert [r["crawl_delay_ms"] for r in found] == [1000, 1000, 1000, 0, 0, 0, 0] and found[0]["rules"] == "kept"


def test_refreshes_match_one_by_one_processing():
    import numpy as np

    from pagewright.streaming.robots_state import due

    draw = random.Random(9)
    for _ in range(50):
        at = sorted(draw.randrange(200) for _ in range(draw.randrange(30)))
        ok, last, fine = [draw.random() < 0.6 for _ in at], draw.choice([None, 5]), True
        expected, held, held_ok = [], last, fine
        for t, o in zip(at, ok, strict=True):
            expected.append(held is None or t - held > (40 if held_ok else 7))
            if expected[-1]:
                held, held_ok = t, o
        fetch, now, now_ok = due(np.array(at, dtype=np.int64), np.array(ok, dtype=bool), last, fine, 40, 7)
        assert fetch.tolist() == expected and (now, now_ok) == (held, held_ok)


def test_first_failure_names_the_page(spark):
    rows = [("", False, "t", 404), ("h/", False, "t", 404), ("h/", True, "t", 404), ("h/", True, "", 404), ("h/", None, None, None)]
    pages = spark.createDataFrame([(*r, '<html lang="fr">') for r in rows], "url string, allowed boolean, transport string, status int, html string")
    found = [r["fetch_error"] for r in filters.page_status(pages, F.col("allowed"), F.col("transport"), F.col("status")).collect()]
    assert found == ["invalid URL", "crawling disallowed", "transport: t", "status 404", "non-English content"]


def test_redirects_and_gates(spark):
    hops = spark.createDataFrame([("a", "b"), ("b", "a")], "url string, target string")
    assert filters.follow_redirects(hops, hops.select("url")).where("error = 'redirect loop'").count() == 2
    pages = spark.createDataFrame([("https://h/", "<html lang=en>"), ("https://h/", "<html lang='fr'>"), ("https://h/", "<p>"), (None, None), ("https://h/", '<html lang="">')], "url string, html string")
    found = [r["fetch_error"] for r in filters.page_status(pages).collect()]
    assert found == ["", "non-English content", "", "invalid URL", "non-English content"]
