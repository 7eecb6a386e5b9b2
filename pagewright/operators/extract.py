"""One fetched page to one structured record of 21 fields."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.html_tree import Node, parse
from pagewright.functions.text import FILTERED_TERMS, RFC3339
from pagewright.functions.urls import SOCIAL_HOSTS, Url, hostname, parse_url, resolve, text_of

NOT_ENGLISH = "non-English content"
FILTERED = "filtered title"
BAD_URL = "invalid URL"
TOO_LONG = "parsing took too long"
NO_URL = "https://localhost/"
# The error texts, the stand-in for a URL, and the elements whose text nobody sees.
SILENT = frozenset(("script", "style", "noscript", "template"))
# Fields that a page without a URL cannot have.
OF_URL = frozenset(("url", "canonical_url", "anchor_texts", "internal_links", "external_links", "social_links", "is_secure"))

_text, _list = T.StringType(), T.ArrayType(T.StringType())
PAGE_SCHEMA = T.StructType(
    [
        T.StructField("url", _text), T.StructField("canonical_url", _text), T.StructField("title", _text), T.StructField("charset", _text),
        T.StructField("meta_description", _text), T.StructField("meta_keywords", _text), T.StructField("language", _text),
        T.StructField("headings", T.MapType(_text, _list)), T.StructField("alt_texts", _list), T.StructField("anchor_texts", _list),
        T.StructField("internal_links", _list), T.StructField("external_links", _list), T.StructField("structured_data", _list),
        T.StructField("open_graph", T.MapType(_text, _text)), T.StructField("date_published", T.TimestampType()),
        T.StructField("date_modified", T.TimestampType()), T.StructField("social_links", _list), T.StructField("visible_text", _text),
        T.StructField("load_time", T.LongType()), T.StructField("is_secure", T.BooleanType()), T.StructField("fetch_error", _text),
    ]
)
EMPTY = {f.name: "" if isinstance(f.dataType, T.StringType) else None for f in PAGE_SCHEMA.fields} | {
    "internal_links": [], "external_links": [], "social_links": [], "load_time": 0, "is_secure": False,
}


def subtree_text(node: Node) -> str:
    """All text below a node, scripts included, without white space at its ends."""
    return "".join(x for x in node.walk() if isinstance(x, str)).strip()


def base_of(tree: Node, page: Url, policy: str = "last") -> Url:
    """The URL that links are relative to.

    By default the last base element of the head decides (the first one anywhere if the head
    has none), and one without a usable href leaves the page's own URL; the policy ``first``
    is the HTML5 rule.
    """
    head = tree.children[0]
    in_head = [c for c in head.children if not isinstance(c, str)]
    if policy == "last":
        in_head.reverse()
    found = [x for c in in_head for x in c.walk() if not isinstance(x, str) and x.tag == "base"]
    found = found or [x for x in tree.walk() if not isinstance(x, str) and x.tag == "base"]
    if policy == "first":
        found = [b for b in found if b.get("href") is not None]
    if not found or found[0].get("href") is None:
        return page
    reference = parse_url(found[0].get("href"))
    return page if reference is None else resolve(page, reference)


def instant(text: str) -> datetime | None:
    if not re.match(RFC3339, text):
        return None
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00").replace(",", "."))
    except ValueError:
        return None


def metadata(nodes: list[Node]) -> dict:
    """What the meta elements say; later ones replace earlier ones."""
    found: dict = {}
    for node in nodes:
        name, content, charset, prop = (node.get(x) or "" for x in ("name", "content", "charset", "property"))
        if charset:
            found["charset"] = charset
        elif (node.get("http-equiv") or "").lower() == "content-type":
            _, marked, value = content.partition("charset=")
            if marked:
                found["charset"] = value.strip()
        elif prop.startswith("og:"):
            found.setdefault("open_graph", {})[prop] = content
        elif name == "description":
            found["meta_description"] = content
        if prop in ("article:published_time", "datepublished") and (at := instant(content)):
            found["date_published"] = at
        if prop in ("article:modified_time", "datemodified") and (at := instant(content)):
            found["date_modified"] = at
    return found


def record(url: str | None, html: str | None, base_policy: str = "last", parse_seconds: float | None = None, references: str = "html5") -> dict:
    """The page's fields, or an empty record with ``fetch_error``."""
    full = url if url and url.startswith(("http://", "https://")) else f"https://{url or ''}"
    page = parse_url(full)
    if page is None:
        return EMPTY | {"fetch_error": BAD_URL}
    try:
        tree = parse(html or "", parse_seconds, references)
    except TimeoutError:
        return EMPTY | {"fetch_error": TOO_LONG}
    base = base_of(tree, page, base_policy)
    lang = tree.get("lang")
    if lang is not None and lang.split("-", 1)[0].lower() != "en":
        return EMPTY | {"fetch_error": NOT_ENGLISH}
    by_tag: dict[str, list[Node]] = defaultdict(list)
    visible: list[str] = []
    stack: list[tuple[Node | str, str]] = [(tree, "")]
    while stack:
        x, parent = stack.pop()
        if isinstance(x, str):
            if parent not in SILENT:
                visible.append(x)
        else:
            by_tag[x.tag].append(x)
            stack.extend((c, x.tag) for c in reversed(x.children))
    titles = [subtree_text(t) for t in by_tag["title"]]
    if any(term in t.lower() for t in titles for term in FILTERED_TERMS):
        return EMPTY | {"fetch_error": FILTERED}
    found = EMPTY | metadata(by_tag["meta"])
    internal, external, social, anchors = [], [], [], []
    for a in by_tag["a"]:
        reference = parse_url(a.get("href")) if a.get("href") else None
        target = resolve(base, reference) if reference else None
        if target is None or target.scheme not in ("http", "https"):
            continue
        text = subtree_text(a)
        if text:
            anchors.append(text)
        if target.authority == base.authority:
            internal.append(text_of(target))
        else:
            external.append(text_of(target))
            if hostname(target) in SOCIAL_HOSTS:
                social.append(external[-1])
    headings = {tag: [subtree_text(n) for n in by_tag[tag]] for tag in ("h1", "h2", "h3", "h4", "h5", "h6") if by_tag[tag]}
    canonical = ""
    for link in by_tag["link"]:
        reference = parse_url(link.get("href")) if "canonical" in (link.get("rel") or "").lower() and link.get("href") else None
        if reference:
            canonical = text_of(resolve(base, reference))
    structured = ["".join(c for c in s.children if isinstance(c, str)) for s in by_tag["script"] if (s.get("type") or "").lower() == "application/ld+json"]
    return found | {
        "url": full, "canonical_url": canonical, "title": titles[-1] if titles else "", "language": "unspecified" if lang is None else lang.strip(),
        "headings": headings or None, "alt_texts": [i.get("alt") for i in by_tag["img"] if i.get("alt")] or None, "anchor_texts": anchors or None,
        "internal_links": internal, "external_links": external, "social_links": social, "structured_data": [s for s in structured if s] or None,
        "visible_text": " ".join(" ".join(visible).split()), "is_secure": base.scheme == "https",
    }


def spread(df: DataFrame) -> DataFrame:
    """At least a task a core: small inputs come in few file splits, large ones in enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def extract_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id",), fields: tuple[str, ...] | None = None, base_policy: str = "last", batch_rows: int = 256, parse_seconds: float | None = None, references: str = "html5") -> DataFrame:
    """``keep`` and the record's fields (or some of them) of every page (columns url, html).

    Without a column url the records are of the html alone, and no bad URL empties one.  Every
    page is parsed to its end; a caller that gives up on pages after ``parse_seconds`` must take
    ``fetch_error`` too, which tells these from pages that hold nothing.  Character references
    are read by the rules of HTML5, or with ``references="ended"`` only where a semicolon ends them.
    """
    chosen = [f for f in PAGE_SCHEMA.fields if fields is None or f.name in fields]
    names = {f.name for f in chosen}
    if parse_seconds is not None and "fetch_error" not in names:
        raise ValueError("parse_seconds needs fetch_error among the fields")
    has_url = "url" in pages.columns
    if not has_url and names & OF_URL:
        raise ValueError(f"without a column url there is no {', '.join(sorted(names & OF_URL))}")
    inputs = pages.select(*[F.col(k).alias(f"__{k}") for k in keep], *["url"][:has_url], "html")
    schema = T.StructType([*(T.StructField(f"__{k}", inputs.schema[f"__{k}"].dataType) for k in keep), *chosen])
    arrow = {f.name: _arrow(f.dataType) for f in chosen}

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(start, batch_rows)
                urls = batch.column("url").to_pylist() if has_url else [NO_URL] * batch.num_rows
                rows = [record(u, h, base_policy, parse_seconds, references) for u, h in zip(urls, batch.column("html").to_pylist(), strict=True)]
                columns = [batch.column(f"__{k}") for k in keep]
                for name, kind in arrow.items():
                    values = [list(r[name].items()) if isinstance(r[name], dict) else r[name] for r in rows]
                    columns.append(pa.array(values, kind))
                yield pa.RecordBatch.from_arrays(columns, names=[*(f"__{k}" for k in keep), *arrow])

    found = spread(inputs).mapInArrow(extracted, schema)
    return found.select(*[F.col(f"__{k}").alias(k) if k not in arrow else F.col(f"__{k}").alias(f"page_{k}") for k in keep], *arrow)


def _arrow(kind: T.DataType) -> pa.DataType:
    match kind:
        case T.ArrayType():
            return pa.list_(_arrow(kind.elementType))
        case T.MapType():
            return pa.map_(_arrow(kind.keyType), _arrow(kind.valueType))
        case T.TimestampType():
            return pa.timestamp("us", tz="UTC")
        case T.LongType():
            return pa.int64()
        case T.BooleanType():
            return pa.bool_()
    return pa.string()


def link_rows(extracted: DataFrame) -> DataFrame:
    """One row per link: page_id, kind, pos (0-based inside its kind), link.

    Both kinds come from one generator, so a page is parsed once.
    """

    def side(kind: str) -> Column:
        return F.transform(f"{kind}_links", lambda link, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), link.alias("link")))

    return extracted.select("page_id", F.inline(F.concat(side("internal"), side("external"))))


class ExtractLinks:
    """Table function: (kind, pos, link) of every link of a page given as url and html."""

    def eval(self, url: str, html: str):
        found = record(url, html)
        for kind in ("internal", "external"):
            for pos, link in enumerate(found[f"{kind}_links"]):
                yield kind, pos, link


def register_extract_links(spark: SparkSession, name: str = "extract_links") -> None:
    """Let SQL call ``ExtractLinks`` as ``SELECT ... FROM pages, LATERAL extract_links(url, html)``."""
    spark.udtf.register(name, F.udtf(ExtractLinks, returnType="kind string, pos int, link string", useArrow=True))
