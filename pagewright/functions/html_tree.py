"""A small HTML tree builder: enough of the HTML5 rules for text and link extraction.

It knows void elements, raw-text and escapable raw-text elements, implied ends of paragraphs,
list items, table parts and options, the implied html, head and body elements, and character
references.  It does not re-open formatting elements or move text out of tables; text keeps
its order in either case.
"""

from __future__ import annotations

import re
from time import monotonic
from collections.abc import Callable, Iterator
from html import unescape
from html.entities import html5

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr basefont bgsound keygen".split())
RAW = frozenset("script style noscript iframe xmp noembed noframes".split())
ESCAPABLE = frozenset("title textarea".split())
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section select summary table caption "
    "tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr option optgroup select legend".split())
#: What a start tag ends, and the elements beyond which it does not look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
CELLS = frozenset("td th caption table".split())
TABLE_PARTS = frozenset("table tr tbody thead tfoot td th".split())
TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"'=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)(?P<end>>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ENDED = re.compile("&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")


class Node:
    """An element; ``children`` holds nodes and strings in page order."""

    __slots__ = ("tag", "attributes", "parent", "children")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        if parent is not None:
            parent.children.append(self)

    def get(self, name: str) -> str | None:
        return self.attributes.get(name)

    def walk(self) -> Iterator[Node | str]:
        """This node and everything below it in page order."""
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            yield x
            if not isinstance(x, str):
                stack.extend(reversed(x.children))


def unescape_ended(text: str) -> str:
    """Character references that end in a semicolon, and no others, decoded."""
    return ENDED.sub(lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


#: How references are read: by HTML5 some names need no semicolon.
REFERENCES: dict[str, Callable[[str], str]] = {"html5": unescape, "ended": unescape_ended}


def attributes(source: str, decode: Callable[[str], str] = unescape) -> dict[str, str]:
    """Names in lower case; the first of equal names counts."""
    found: dict[str, str] = {}
    if source.strip(" \t\r\n\f/"):
        for name, double, single, bare in ATTRIBUTE.findall(source):
            found.setdefault(name.lower(), decode(double or single or bare))
    return found


class _Builder:
    def __init__(self) -> None:
        self.html = Node("html", {}, None)
        self.head = Node("head", {}, self.html)
        self.body: Node | None = None
        self.open: list[Node] = []  # below head or body
        self.at: dict[str, list[int]] = {}  # where in ``open`` elements of a name are
        self.pieces: list[str] = []  # text that ``into`` has not got yet: joined once, however many
        self.into: Node | None = None

    def flush(self) -> None:
        if self.pieces:
            self.into.children.append("".join(self.pieces))
            self.pieces = []

    def start_body(self, values: dict[str, str]) -> None:
        if self.body is None:
            self.flush()
            self.body = Node("body", values, self.html)
            self.cut(0)

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def cut(self, place: int) -> None:
        """Close all open elements from a place on."""
        for node in self.open[place:]:
            self.at[node.tag].pop()
        del self.open[place:]

    def nearest(self, tags) -> int:
        """The place of the innermost open element with one of the names, or -1."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=-1)

    def top(self) -> Node:
        return self.open[-1] if self.open else self.body or self.head

    def text(self, value: str) -> None:
        if not self.open and self.body is None:
            if not value.strip(" \t\r\n\f"):
                return
            self.start_body({})
        top = self.top()
        if top is not self.into:
            self.flush()
            self.into = top
        self.pieces.append(value)

    def end(self, tags: set[str] | frozenset[str], fence: set[str]) -> None:
        """Close the nearest open element named in ``tags`` unless one of ``fence`` is nearer."""
        outer = self.nearest(tags)
        if outer < 0 or self.nearest(fence - tags) > outer:
            return
        while outer and self.open[outer - 1].tag in tags and len(tags) > 2:
            outer -= 1
        self.cut(outer)

    def start(self, tag: str, values: dict[str, str]) -> bool:
        """Open an element; whether it can have content."""
        if tag == "html":
            for name, value in values.items():
                self.html.attributes.setdefault(name, value)
            return False
        if tag == "head":
            return False
        if tag == "body":
            self.start_body(values)
            return False
        if self.body is None and not self.open and tag not in HEAD:
            self.start_body({})
        if tag in CLOSES_P:
            self.end({"p"}, {"button", "table", "td", "th", "caption", "object", "template", "marquee", "applet"})
        if re.fullmatch("h[1-6]", tag) and self.open and re.fullmatch("h[1-6]", self.open[-1].tag):
            self.cut(len(self.open) - 1)
        if tag == "a":
            self.end({"a"}, {"table", "td", "th", "caption", "object", "template", "marquee", "applet"})
        if tag in ENDS:
            self.end(*ENDS[tag])
        self.flush()
        node = Node(tag, values, self.top())
        if tag in VOID:
            return False
        self.push(node)
        return True

    def close(self, tag: str) -> None:
        if tag == "p" and self.nearest(("p",)) < 0:
            self.start("p", {})
        place = self.nearest((tag,))
        if place < 0:
            return
        if tag not in TABLE_PARTS and self.nearest(CELLS) > place:
            return
        self.cut(place)


def parse(source: str, seconds: float | None = None, references: str = "html5") -> Node:
    """The html element of a page; ``TimeoutError`` where that takes longer than ``seconds``."""
    builder, at, n, decode = _Builder(), 0, len(source), REFERENCES[references]
    end = None if seconds is None else monotonic() + seconds
    tokens = 0
    source = source.replace("\r\n", "\n").replace("\r", "\n") if "\r" in source else source
    n = len(source)
    while at < n:
        if end is not None and tokens % 256 == 0 and monotonic() >= end:
            raise TimeoutError
        tokens += 1
        less = source.find("<", at)
        if less < 0:
            builder.text(decode(source[at:]))
            break
        token = TOKEN.match(source, less)
        if token is None:  # a bare less-than sign
            builder.text(decode(source[at : less + 1]))
            at = less + 1
            continue
        if less > at:
            builder.text(decode(source[at:less]))
        at = token.end()
        name = token["name"]
        if name is None or not token["end"]:
            continue  # a comment, a declaration, or a tag that the end of the page cuts off
        tag = name.lower()
        if token["close"]:
            builder.close(tag)
            continue
        if builder.start(tag, attributes(token["rest"], decode)) and (tag in RAW or tag in ESCAPABLE):
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.I).search(source, at)
            content = source[at : stop.start() if stop else n]
            if content:
                builder.text(content if tag in RAW else decode(content))
            builder.cut(len(builder.open) - 1)
            at = stop.end() if stop else n
    builder.start_body({})
    builder.flush()
    return builder.html
