import html
import re

from pagewright.llm import htmltext

PAGE = """<html><body><div id="page"><div class="header">Site</div><div class="main-menu"><a href=1>one</a> <a href=2>two</a></div>
<div class="content"><h2>Title here</h2><p>First paragraph of some length &amp; words that go on for quite
a while.</p><div><p>Second, with <a href=q>a link</a>.</p></div><p>Third.</p><ul><li>item a</li><li>item b</li></ul><form>Name <input></form></div>
<div class="comments"><p>Reader one says this is a long long comment that is prose, and it goes on.</p></div><div class="sidebar">x y z</div></div>
<div role="alert">We use cookies</div><div id="footer">foot</div></body></html>"""


def test_article_of_a_page():
    assert htmltext.main_text(PAGE).split("\n") == [
        "Title here", "First paragraph of some length & words that go on for quite a while.", "Second, with a link.", "Third.", "item a", "item b",
    ]


def test_nothing_in_an_article_is_dropped():
    parts = "<section><h1>Head</h1><section><p>" + "w " * 200 + "</p></section><section><p>tiny</p></section></section>"
    assert htmltext.main_text(f"<body><nav><a>x</a></nav>{parts}</body>").split("\n")[::2] == ["Head", "tiny"]
    assert htmltext.main_text("<body><p>Short one.<p>Two</body>") == "Short one.\nTwo"


def test_text_beside_an_article_without_links():
    prose = "<p>A first paragraph of prose, long enough to read.</p><p>A second one that goes on for a while.</p>"
    for own in ("article", "main", "div"):
        for menu in ("", "<nav><a href=1>one</a></nav>"):
            page = f"<body>{menu}<div>tagline</div><{own}><h1>Head</h1>{prose}</{own}><div>Copyright</div></body>"
            assert htmltext.main_text(page) == "Head\nA first paragraph of prose, long enough to read.\nA second one that goes on for a while."


def test_a_wrapper_of_the_article_stays():
    prose = "<p>A first paragraph of prose, long enough to read.</p><p>A second one that goes on for a while.</p>"
    text = htmltext.main_text(f"<body>{prose}</body>")
    wrappers = ['div class="layout has-sidebar"', 'div class="post comments-open"', 'section class="ad-free"', "form", 'div id="page-header"', 'div class="widget"', 'header class="banner"']
    for wrapper in wrappers:
        for own in (prose, f"<article>{prose}</article>", f'<main><div class="sidebar">x y z</div>{prose}</main>'):
            page = f'<body><{wrapper}>{own}<div class="sidebar">x y z</div></{wrapper.split()[0]}><div class="footer">foot</div></body>'
            assert htmltext.main_text(page) == text, page
    # every part of the page in a wrapper of its own, and the state of a part
    post = '<div class="post comments-open"><p>{}</p></div>'
    assert htmltext.main_text("<body>" + "".join(post.format(w * 60) for w in "abc") + "</body>").split("\n") == [w * 60 for w in "abc"]


def test_what_is_no_article_goes_beside_it():
    article = "<p>A paragraph of prose.</p><p>And another.</p>"
    reader = '<article class="comment-body"><p>' + "A reader goes on and on. " * 20 + "</p></article>"
    for own in (f"<article>{article}</article>", f"<div>{article}</div>"):
        for other in (f'<div id="comments" class="comments-area">{reader * 3}</div>', '<div class="related"><article>Card</article></div>', "<form>Name <input></form>"):
            assert htmltext.main_text(f"<body>{own}{other}</body>") == "A paragraph of prose.\nAnd another.", (own, other)
        page = f'<body><article>{article}<div class="comments"><p>{"A reader goes on. " * 20}</p></div></article></body>'
        assert htmltext.main_text(page) == "A paragraph of prose.\nAnd another."


def test_corpus_articles(spark, sf):
    """Every article of the corpus against a plain reading of its markup."""
    for r in htmltext.extract(spark.read.parquet(f"{sf}/pages.parquet"), keep=("page_id", "html")).collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", r["html"], re.S)
        body = re.sub(r"<[^>]*$", "", body.group(1)) if body else ""
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", body)]
        expected = "\n".join(b for b in blocks if b)
        assert (r["text"], r["n_chars"]) == (expected, len(expected))


def test_odd_pages(spark):
    pages = [None, "", " ", "plain text", "<", "<p>", "<div>" * 5000 + "deep", "<script>x</script>", "<p>a&nbsp; &#8212; b</p>" * 3, "<p>" + "long " * 50_000]
    rows = spark.createDataFrame([(i, None, h, "t") for i, h in enumerate([*pages, pages[3]])], "page_id long, url string, html string, text string")
    found = {r["page_id"]: r["text"] for r in htmltext.extract(rows).collect()}
    assert [found[i] for i in range(9)] == ["", "", "", "plain text", "<", "", "deep", "", "a — b\na — b\na — b"]
    assert len(found[9]) == 249_999 and htmltext.extract(rows.limit(0)).count() == 0


PROSE = "<p>Prose that goes on for a good while, long enough to be read as text.</p>"
MENU = "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(30))


def test_density_decides_where_names_say_nothing():
    line, link = re.sub("<.*?>", "", PROSE), "<p>and <a href=x>one</a></p>"
    stray = f'<body><div class="z">A stray line</div><article><h1>H</h1>{PROSE * 3}{link}</article><div class="z">Copyright 2020</div></body>'
    assert htmltext.main_text(stray).split("\n") == ["H", line, line, line, "and one"]
    assert htmltext.main_text(f'<body><main><div class="q"><ul>{MENU}</ul></div><h1>H</h1>{PROSE * 3}</main></body>').split("\n") == ["H", line, line, line]
    beside = f'<body><div class="a"><ul>{MENU}</ul></div><div class="b"><div>{PROSE * 4}</div></div><div class="c">{"<a href=q>w</a> " * 20}</div></body>'
    assert htmltext.main_text(beside).split("\n") == [line] * 4


def test_names_take_no_prose_for_a_listed_word():
    line = re.sub("<.*?>", "", PROSE)
    parts = "".join(f'<div class="{name}">{PROSE}</div>' for name in ("widget-guide", "share-price", "BannerStory"))
    page = f'<body><article><h1>H</h1>{PROSE}{parts}<section id="warning-colours">{PROSE}</section><div class="share-buttons">Share</div></article></body>'
    assert htmltext.main_text(page).split("\n") == ["H", *[line] * 5]


def test_articles_are_found_by_density_alone(spark, sf):
    """The corpus with all telling names taken away."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()]
    plain = [re.sub(r"<(/?)(?:nav|footer|article)\b", r"<\1div", x.replace(' class="ad"', "")) for x in pages]
    assert sum(htmltext.main_text(a) == htmltext.main_text(b) for a, b in zip(pages, plain, strict=True)) >= 0.9 * len(pages)


def test_densities_match_the_formula():
    """Every node's density and density sum, counted anew for each node from its whole subtree."""
    from math import e, log

    pages = [f"<body>{PROSE * 2}<div><ul>{MENU}</ul><p>x <a href=1>yy</a></p></div></body>", f"<body><div>{PROSE}</div><div>t<b>u</b></div></body>", "<body>a</body>"]
    for page in pages:
        found = htmltext.boxes(next(c for c in htmltext.parse(page).children if not isinstance(c, str) and c.tag == "body"))
        htmltext.measure(found)

        def counts(node):
            below = [x for x in node.walk() if x is not node]
            size = lambda n: sum(len("".join(x.split())) for x in n.walk() if isinstance(x, str))
            tags = [x for x in below if not isinstance(x, str)]
            links = [x for x in tags if x.tag == "a"]
            return size(node), len(tags), size(node) if node.tag == "a" else sum(map(size, links)), len(links)

        whole = counts(found[0].node)

        def density(node):
            c, t, lc, lt = counts(node)
            if not c or not whole[2]:
                return c / max(1, t)
            base = log(c / max(1, c - lc) * lc + whole[2] / whole[0] * c + e) if lc else log(c / max(1, c - 1) * 1 + whole[2] / whole[0] * c + e)
            ratio = (c / max(1, lc)) * (max(1, t) / max(1, lt))
            return c / max(1, t) * (log(ratio) / max(1.0, log(base)) if ratio > 1 else 0.0)

        for box in found:
            if box.link_chars:
                assert abs(box.density - density(box.node)) < 1e-9
            children = [p for p in box.parts if not isinstance(p, str)]
            assert abs(box.density_sum - sum(c.density for c in children)) < 1e-9
            if not whole[2]:
                assert box.density == density(box.node)
