import pytest

from pagewright.functions.html_tree import parse
from pagewright.operators.extract import EMPTY, FILTERED, NOT_ENGLISH, extract_pages, record

FULL = """<!doctype html><html lang="en-NZ"><head><meta charset="windows-1252"><title>Kea nests above the bushline</title>
<base href="http://birds.test/alpine/"><meta name="description" content="Field notes from three winters"></head><body>
<h2>Sites</h2><h2>Methods</h2><h4>Bands</h4><p>See <a href="map?year=3">the map</a>, <a href="../forest/">the forest sites</a>
and <a href="https://archive.test/kea.csv">all counts</a>, or ask <a href="https://instagram.com/kea">us</a>.</p>
<img alt="A kea on a hut roof" src="k.jpg"><img src="n.jpg"><script type="application/ld+json">{"@type": "Dataset"}</script></body></html>"""


def test_full_page():
    r = record("https://birds.test/alpine/nests.html", FULL)
    assert (r["title"], r["language"], r["charset"]) == ("Kea nests above the bushline", "en-NZ", "windows-1252")
    assert r["is_secure"] is False and r["meta_description"] == "Field notes from three winters"
    assert r["internal_links"] == ["http://birds.test/alpine/map?year=3", "http://birds.test/forest/"]
    assert r["external_links"] == ["https://archive.test/kea.csv", "https://instagram.com/kea"] and r["social_links"] == r["external_links"][1:]
    assert r["headings"] == {"h2": ["Sites", "Methods"], "h4": ["Bands"]} and r["alt_texts"] == ["A kea on a hut roof"]
    assert r["structured_data"] == ['{"@type": "Dataset"}'] and r["anchor_texts"] == ["the map", "the forest sites", "all counts", "us"]


@pytest.mark.parametrize(
    "html, field, value",
    [
        ('<html lang="es">', "fetch_error", NOT_ENGLISH), ("<title>Porn Site</title>", "fetch_error", FILTERED), ("<title>Essex news</title>", "fetch_error", FILTERED),
        ('<html lang="en-GB">', "language", "en-GB"), ('<html lang="en_US">', "fetch_error", NOT_ENGLISH), ('<html lang="">', "fetch_error", NOT_ENGLISH),
        ("<title>x</title>", "language", "unspecified"), ("<title>A</title><svg><title>B</title></svg>", "title", "B"),
        ("<template>a<p>b</p></template>", "visible_text", "b"), ("wor<b>ld</b>", "visible_text", "wor ld"), ("<h2></h2>", "headings", {"h2": [""]}),
        ('<a href="">t</a><a href="/x"></a>', "anchor_texts", None), ('<a href="">t</a><a href="/x"></a>', "internal_links", ["https://example.com/x"]),
        ("<title>Tide table</title><body>High water\n at six", "visible_text", "Tide table High water at six"), ("<p>a<script>x</script><noscript>n</noscript>b", "visible_text", "a b"),
        (None, "visible_text", ""), ("", "internal_links", []), ("<a href='x'>a&nbsp;&amp;&am</a>", "anchor_texts", ["a\xa0&&am"]),
    ],
)
def test_fields(html, field, value):
    assert record("https://example.com/", html)[field] == value


def test_ports_bases_and_errors():
    assert record("https://h:8443/", '<a href="https://h/x">t</a>')["external_links"] == ["https://h/x"]
    downgraded = record("https://p/", '<base href="http://h/"><a href="/x">t</a>')
    assert downgraded["is_secure"] is False and downgraded["internal_links"] == ["http://h/x"]
    two = '<base href="/a/"><base href="/b/"><a href=x>t</a>'
    assert record("https://p/", two)["internal_links"] == ["https://p/b/x"]
    assert record("https://p/", two, base_policy="first")["internal_links"] == ["https://p/a/x"]
    assert record("bad host/", "x") == EMPTY | {"fetch_error": "invalid URL"}


def test_dates():
    r = record("h", '<meta property="article:published_time" content="2024-01-02T03:04:05+02:00"><meta property="datemodified" content="2024-01-02">')
    assert r["date_published"].isoformat() == "2024-01-02T03:04:05+02:00" and r["date_modified"] is None


def test_tree_survives_broken_markup():
    for html in ("<", "<a", "</", "<!--", "<a href='x", "<p><table><p>", "</p>", "<script>", "a<b", "<a <b>", "<title>x", "&#xD800;", "<br/></br>"):
        assert parse(html).tag == "html"
    assert record("h", "<p>" * 20_000 + "x")["visible_text"] == "x"
    assert record("h", "<div>" * 20_000 + "x")["visible_text"] == "x"


def test_long_pages_take_linear_time():
    from time import process_time

    for part in ("<div>", "<span>", "<td><b>", "</b><i>"):
        start = process_time()
        parse(part * 100_000 + "<p>x</p>" * 20_000 + "</i></b>" * 20_000)
        assert process_time() - start < 20


def test_parsing_has_a_deadline():
    from pagewright.operators.extract import TOO_LONG

    with pytest.raises(TimeoutError):
        parse("<p>x", seconds=0)
    assert record("h", "<p>x", parse_seconds=0) == EMPTY | {"fetch_error": TOO_LONG}
    assert record("h", "<p>x", parse_seconds=60)["visible_text"] == "x"


def test_native_gates_let_through_what_the_tree_accepts(spark):
    from pagewright.operators.filters import page_status

    htmls = [
        '<!-- <html lang="fr"> --><html lang="en"><title>a</title>', '<html lang="en"><script>"<title>porn</title>"</script><title>a</title>',
        '<html lang="en"><!-- <title>gore</title> --><title>a</title>', '<html lang="en"><title>a</title><svg><title>porn</title></svg>',
        '<html lang="fr"><title>a</title>', '<html lang="en"><title>Porn</title>', "<title>a</title>", "a" + "é" * 1_100_000,
    ]
    pages = spark.createDataFrame([(i, "https://h/", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    native = {r["page_id"]: r["fetch_error"] for r in page_status(pages).select("page_id", "fetch_error").collect()}
    tree = {i: record("https://h/", h)["fetch_error"] for i, h in enumerate(htmls[:-1])}
    assert {i: native[i] for i in tree} == tree and native[len(tree)] == "invalid UTF-8"


def test_links_come_from_one_parse(spark, sf):
    from pagewright.plans import catalog

    plan = catalog.links_of(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_frame_keeps_ids_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "https://h/", FULL, "z"), (2, None, None, "z")], "page_id long, url string, html string, title string")
    found = extract_pages(pages).collect()
    assert {r["page_id"] for r in found} == {1, 2} and len(found[0]) == 22
    assert extract_pages(pages.limit(0)).count() == 0


SLOW = '<html lang="en"><title>Tides</title><h1>High water</h1>' + "<" * 1_000_000  # once quadratic: far more than five seconds of parsing


def written(spark, at, *rows):
    """A folder with a table of pages, as queries take it."""
    spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at)


def test_headings_of_slow_pages_and_of_pages_with_bad_urls(spark, tmp_path):
    from pagewright.plans import catalog

    short = SLOW.rstrip("<")
    at = written(spark, tmp_path, ("https://h/", SLOW), ("bad host/", short), (None, short), ("https://h/", short.replace("en", "fr")))
    found = sorted((r["page_id"], r["tag"], r["pos"], r["heading"][:10]) for r in catalog.QUERIES["headings"](spark, at).collect())
    assert found == [(i, "h1", 0, "High water") for i in range(3)]


def test_visible_text_of_slow_pages_and_of_pages_with_bad_urls(spark, tmp_path):
    from pagewright.plans import catalog

    short = SLOW.rstrip("<")
    at = written(spark, tmp_path, ("https://h/", SLOW), ("bad host/", short), (None, short), ("https://h/", short.replace("en", "fr")))
    found = sorted((r["page_id"], r["visible_text"][:16]) for r in catalog.QUERIES["visible_text"](spark, at).collect())
    assert found == [(i, "Tides High water") for i in range(3)]


CUT = '<html lang="en"><meta charset="utf-8"><title>Tern &amp; skua &amp</title><h1>Gull &quot;x&quot; &quot</h1>&#233;&am'


def test_references_by_html5_or_with_their_semicolon():
    assert record("https://h/", CUT)["visible_text"] == 'Tern & skua & Gull "x" " é&am'
    assert record("https://h/", CUT, references="ended")["visible_text"] == 'Tern & skua &amp Gull "x" &quot é&am'
    assert record("https://h/", "<title>&nosuch; &ampamp; &#xe9;&#xe9 &amp;amp;</title>", references="ended")["title"] == "&nosuch; &ampamp; é&#xe9 &amp;"


def test_extract_page_reads_references_as_its_sql(spark, tmp_path):
    from pagewright.plans import catalog

    found = catalog.QUERIES["extract_page"](spark, written(spark, tmp_path, ("https://h/", CUT))).collect()
    assert [(r["page_id"], r["title"], r["charset"]) for r in found] == [(0, "Tern & skua &amp", "utf-8")]


def test_headings_reads_references_as_its_sql(spark, tmp_path):
    from pagewright.plans import catalog

    found = catalog.QUERIES["headings"](spark, written(spark, tmp_path, ("https://h/", CUT))).collect()
    assert [tuple(r) for r in found] == [(0, "h1", 0, 'Gull "x" &quot')]


def test_page_json_sink_reads_references_as_its_sql(spark, tmp_path):
    from pagewright.plans import catalog

    found = catalog.QUERIES["page_json_sink"](spark, written(spark, tmp_path, ("https://h/", CUT))).collect()
    assert [tuple(r) for r in found] == [("https://h/", "Tern & skua &amp", "en", 0)]


def test_page_title_reads_references_as_its_sql(spark, tmp_path):
    from pagewright.plans import catalog

    found = catalog.QUERIES["page_title"](spark, written(spark, tmp_path, ("https://h/", CUT))).collect()
    assert [tuple(r) for r in found] == [(0, "Tern & skua &amp")]


def test_visible_text_reads_references_as_its_sql(spark, tmp_path):
    from pagewright.plans import catalog

    found = catalog.QUERIES["visible_text"](spark, written(spark, tmp_path, ("https://h/", CUT))).collect()
    assert [tuple(r) for r in found] == [(0, 'Tern & skua &amp Gull "x" &quot é&am')]


def test_bare_less_than_signs_take_linear_time():
    from time import process_time

    start = process_time()
    tree = parse("<p>a" + "<" * 1_000_000)
    assert process_time() - start < 10 and tree.children[1].children[0].children == ["a" + "<" * 1_000_000]


def test_failures_never_look_like_empty_pages(spark):
    from pagewright.operators.extract import TOO_LONG

    pages = spark.createDataFrame([(1, "https://h/", FULL)], "page_id long, url string, html string")
    with pytest.raises(ValueError):
        extract_pages(pages, fields=("headings",), parse_seconds=1)
    with pytest.raises(ValueError):
        extract_pages(pages.drop("url"), fields=("internal_links", "headings"))
    assert extract_pages(pages, fields=("headings", "fetch_error"), parse_seconds=0).first()["fetch_error"] == TOO_LONG
