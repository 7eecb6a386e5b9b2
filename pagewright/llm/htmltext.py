"""Main-text extraction by composite text density.

For every DOM node its characters, tags, link characters and link tags are counted below it.
A node's density is its characters per tag, multiplied by a logarithm whose base (at least e)
grows with the node's share of link characters, so that menus fall far below prose; where no
link is left below the body, the density is the characters per tag.  A node's density sum adds
up its children.  The node of the largest density sum is the centre; the smallest density on its
path to the body is the threshold, and every node at or over the threshold marks the node of the
largest density sum below it.  The article is the smallest subtree around the centre that holds
``SHARE`` of the characters outside links of all marked nodes; if it is most of an enclosing
article or main element, it is that element, with its headings.  Inside it, a block of links
whose density is under the threshold is a menu and goes.

Elements that are no article by their tag or role (menus, footers, adverts, forms, scripts,
styles) are taken out before densities are counted.  Names are a supplement: an element goes by
its class or id only if all words of a name are listed or say nothing (``site-footer``, not
``share-price`` or ``has-sidebar``).  A form, or an element named by its
class or id, stays if it holds a main element, half of the characters of the page's articles, or
without articles most of the body's; reader comments never stay for their length alone.  In the
article, each block-level element ends a block of text.

Defined results: a null or empty page, or one without text, has the empty text.  A page
without markup is one block.  Nothing in the article is dropped or capped, and a page of any
length is read whole.  Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.html_tree import BLOCKS, Node, parse

# What is no article by element name, by role, and by a word of its class or id.
OUTSIDE = frozenset(
    "head script style noscript template nav aside footer button select textarea input iframe object embed applet svg canvas dialog menu audio video map".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies discussion "
    "disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion "
    "related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar warning widget widgets".split()
)
KEPT = frozenset("html body article main".split())
#: Words that may stand beside a listed one and say nothing of what an element holds.
NEUTRAL = frozenset(
    "site page main top bottom left right container wrapper wrap box list bar area block inner outer link links button buttons btn item items row "
    "col column primary secondary global mobile desktop post posts article body group holder panel form text js id the".split()
)
#: Of the marked characters, what the article must hold.
SHARE = 0.75
#: A block with so many links, and this share of its characters in them, may be a menu.
MENU_LINKS, MENU_SHARE = 3, 0.75
#: Reader comments may be longer than the article.
READERS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())


def outside(node: Node) -> bool:
    """Whether an element is no part of an article, whatever it holds."""
    if node.tag in OUTSIDE:
        return True
    if node.tag in KEPT or not node.attributes:
        return False
    role = (node.get("role") or "").lower()
    if role in ROLES or node.get("hidden") is not None or (node.get("aria-hidden") or "").lower() == "true":
        return True
    return "display:none" in (node.get("style") or "").lower().replace(" ", "")


def named(node: Node) -> set[str]:
    """The listed words that stand for an element in its class and id."""
    found: set[str] = set()
    if node.attributes:
        for name in f"{node.get('class') or ''} {node.get('id') or ''}".split():
            words = {part.lower() for part in re.split(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+", name) if part}
            if words <= WORDS | NEUTRAL:
                found |= words & WORDS
    return found


def suspected(node: Node, in_article: bool) -> set[str]:
    """The words for which an element is no part of an article, unless it holds the article."""
    if node.tag in KEPT:
        return set()
    words = named(node)
    if node.tag == "header" or (in_article and node.tag in ("h1", "h2", "h3")):
        words -= {"header"}
    if node.tag == "form" or (node.tag == "header" and not in_article):
        words |= {node.tag}
    return words


def holders(body: Node) -> dict[int, tuple[bool, bool]]:
    """For each element that may stay: whether it holds the article, and most of the text.

    The text is that of the page's articles or, without any, the body's.
    """
    order, stack = [], [(body, -1, False)]
    while stack:
        node, up, inside = stack.pop()
        # articles named as comments and the like are none of the page's
        own = node.tag == "main" or (node.tag == "article" and not named(node))
        order.append((node, up, inside or own))
        stack.extend((c, len(order) - 1, inside or own) for c in node.children if not isinstance(c, str) and not outside(c))
    chars, articles, mains = [0] * len(order), [0] * len(order), [False] * len(order)
    for i in range(len(order) - 1, -1, -1):
        node, up, inside = order[i]
        own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        chars[i] += own
        articles[i] += own if inside else 0
        mains[i] = mains[i] or node.tag == "main"
        if up >= 0:
            chars[up] += chars[i]
            articles[up] += articles[i]
            mains[up] = mains[up] or mains[i]
    share = articles if articles[0] else chars
    return {id(x): (mains[i] or bool(not inside and 2 * articles[i] >= articles[0] > 0), 2 * share[i] > share[0]) for i, (x, _, inside) in enumerate(order)}


class _Box:
    """A kept element with its counts."""

    __slots__ = ("node", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "density_sum")

    def __init__(self, node: Node, parent: _Box | None):
        self.node, self.parent, self.parts = node, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.density_sum = 0.0


def boxes(body: Node) -> list[_Box]:
    """The kept elements in page order, the body first."""
    top = _Box(body, None)
    found, stack = [top], [(top, False)]
    held: dict[int, tuple[bool, bool]] = {}

    def dropped(node: Node, in_article: bool) -> bool:
        if outside(node):
            return True
        words = suspected(node, in_article)
        if not words:
            return False
        if not held:
            held.update(holders(body))
        has_article, most = held[id(node)]
        return not (has_article or (most and words.isdisjoint(READERS)))

    while stack:
        box, in_article = stack.pop()
        below = []
        for child in box.node.children:
            if isinstance(child, str):
                box.parts.append(child)
            elif not dropped(child, in_article):
                own = _Box(child, box)
                box.parts.append(own)
                below.append((own, in_article or child.tag in ("article", "main")))
        stack.extend(reversed(below))
        if box is not top:
            found.append(box)
    return found


def measure(found: list[_Box]) -> None:
    """Count from the leaves up, then compute densities and density sums."""
    for box in reversed(found):
        for part in box.parts:
            if isinstance(part, str):
                box.chars += len("".join(part.split()))
            else:
                box.chars += part.chars
                box.tags += part.tags + 1
                box.link_chars += part.link_chars
                box.link_tags += part.link_tags + (part.node.tag == "a")
        if box.node.tag == "a":
            box.link_chars = box.chars
    body = found[0]
    link_share = body.link_chars / body.chars if body.chars else 0.0
    for box in reversed(found):
        c, t, lc, lt = box.chars, max(1, box.tags), max(1, box.link_chars), max(1, box.link_tags)
        if c and not body.link_chars:
            box.density = c / t
        elif c:
            base = math.log(c / max(1, c - box.link_chars) * box.link_chars + link_share * c + math.e)
            ratio = (c / lc) * (t / lt)
            box.density = c / t * (math.log(ratio) / max(1.0, math.log(base)) if ratio > 1 and base > 1 else 0.0)
        if box.parent is not None:
            box.parent.density_sum += box.density


def article(found: list[_Box]) -> tuple[_Box, float] | None:
    """The subtree that holds the article, and the threshold."""
    if not found[0].chars:
        return None
    place = {id(b): i for i, b in enumerate(found)}
    centre = max(found, key=lambda b: (b.density_sum, -place[id(b)]))
    threshold, at = centre.density, centre
    while at is not None:
        threshold, at = min(threshold, at.density), at.parent
    # best[i]: the node of the largest density sum at or below found[i]
    best = list(range(len(found)))
    for i in range(len(found) - 1, 0, -1):
        up = place[id(found[i].parent)]
        if found[best[i]].density_sum >= found[best[up]].density_sum:
            best[up] = best[i]
    marked = [False] * len(found)
    for i, box in enumerate(found):
        if box.chars and box.density >= threshold:
            marked[best[i] if found[best[i]].density_sum > 0 else i] = True
    # marked characters outside links at or below each node; what is below a marked node counts once
    held = [0] * len(found)
    for i in range(len(found) - 1, -1, -1):
        if marked[i]:
            held[i] = found[i].chars - found[i].link_chars
        if i:
            held[place[id(found[i].parent)]] += held[i]
    top = centre
    while top.parent is not None and held[place[id(top)]] < SHARE * held[0]:
        top = top.parent
    for tag in ("main", "article"):
        at = top
        while at is not None and at.node.tag != tag:
            at = at.parent
        if at is not None and 2 * (top.chars - top.link_chars) >= at.chars - at.link_chars:
            top = at
    # a line or a block without blocks is widened to what surrounds it
    while top.parent is not None and top.node.tag not in ("article", "main") and (top.node.tag not in BLOCKS or not any(not isinstance(p, str) and p.node.tag in BLOCKS for p in top.parts)):
        top = top.parent
    return top, threshold


def menu(box: _Box, threshold: float) -> bool:
    """Whether a block inside the article is a list of links."""
    return box.density < threshold and box.node.tag in BLOCKS and box.link_tags >= MENU_LINKS and box.link_chars >= MENU_SHARE * box.chars


def blocks(top: _Box, threshold: float = 0.0) -> list[str]:
    """The texts between block boundaries, white space collapsed."""
    found: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            found.append(text)

    stack: list = [top]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.node.tag == "br":
            run.append(" ")
        elif x is not top and menu(x, threshold):
            end()
        else:
            block = x.node.tag in BLOCKS
            if block:
                end()
                stack.append(None)
            stack.extend(reversed(x.parts))
    end()
    return found


def main_text(html: str | None) -> str:
    """The article's blocks, one a line."""
    if not html:
        return ""
    body = next(c for c in parse(html).children if not isinstance(c, str) and c.tag == "body")
    found = boxes(body)
    measure(found)
    chosen = article(found)
    return "\n".join(blocks(*chosen)) if chosen else ""


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` with ``text`` and ``n_chars`` for every page."""
    inputs = pages.select(*keep, F.col(html).alias("__html"))
    fields = [f for f in inputs.schema.fields if f.name != "__html"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "text string", "n_chars long"])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in fields), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*(f.name for f in fields), "text", "n_chars"],
            )

    return inputs.mapInArrow(extracted, schema)
