"""Where pages leave the flow: fetch outcomes, body limits, content gates, one status each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import decoded, decoded_ended, has_filtered_term, is_english, native_lang, native_title, native_titles, without_raw_text
from pagewright.operators.extract import BAD_URL, FILTERED, NOT_ENGLISH

MOST_BYTES = 2 * 1024 * 1024
MOST_REDIRECTS = 3
DISALLOWED = "crawling disallowed"


def truncated(body: Column, most: int = MOST_BYTES) -> Column:
    """The first bytes of a body; a cut inside a character then fails ``is_valid_utf8``."""
    return F.substring(body, 1, most)


def is_utf8(body: Column) -> Column:
    """Whether bytes are whole characters; the cast keeps the bytes as they are."""
    return F.is_valid_utf8(body.cast("string"))


def page_status(pages: DataFrame, allowed: Column | None = None, transport: Column | None = None, status: Column | None = None) -> DataFrame:
    """``fetch_error`` of every page by native gates, first failure first; '' where it passes.

    The order is bad URL, robots (``allowed`` false), ``transport`` error (not empty), ``status``
    other than 200, UTF-8, language, title; what is not given is taken as passed, and a null too.
    The gates read the raw page, so they run before any Python and prune what reaches it.  They
    are a prefilter: what they let through is tested once more on the tree.
    """
    body = F.encode("html", "UTF-8")
    markup = without_raw_text(F.col("html"))
    url_ok = F.coalesce(F.regexp_replace("url", "^https?://", "").rlike(r"^[^\s/?#]"), F.lit(False))
    reason = F.when(~url_ok, BAD_URL)
    if allowed is not None:
        reason = reason.when(~allowed, DISALLOWED)
    if transport is not None:
        reason = reason.when(transport != "", F.concat(F.lit("transport: "), transport))
    if status is not None:
        reason = reason.when(status != 200, F.concat(F.lit("status "), status.cast("string")))
    reason = (
        reason.when(~is_utf8(truncated(body)), "invalid UTF-8")
        .when(~is_english(native_lang(markup)), NOT_ENGLISH)
        .when(has_filtered_term(native_titles(markup)), FILTERED)
        .otherwise("")
    )
    return pages.withColumn("fetch_error", reason)


def accepted(pages: DataFrame) -> DataFrame:
    return page_status(pages).where("fetch_error = ''").drop("fetch_error")


def title_of(html: Column, references: str = "html5") -> Column:
    decode = {"html5": decoded, "ended": decoded_ended}[references]
    return F.regexp_replace(decode(native_title(html)), r"(?U)^\s+|\s+$", "")


def follow_redirects(hops: DataFrame, requests: DataFrame, most: int = MOST_REDIRECTS) -> DataFrame:
    """Final URL and error of each request, given single hops (url, target).

    A chain fails where it meets a URL again or needs more than ``most`` hops; the request's
    own URL stays with the row.
    """
    hop = hops.select(F.col("url").alias("__from"), F.col("target").alias("__to"))
    rows = requests.select("url", F.col("url").alias("final_url"), F.array("url").alias("__chain"), F.lit("").alias("error"))
    for step in range(most + 1):
        rows = rows.join(hop, (F.col("final_url") == F.col("__from")) & (F.col("error") == ""), "left")
        error = (
            F.when(F.col("__to").isNull(), F.col("error"))
            .when(F.array_contains("__chain", F.col("__to")), "redirect loop")
            .when(F.lit(step >= most), "too many redirects")
            .otherwise(F.col("error"))
        )
        goes = F.col("__to").isNotNull() & (error == "")
        rows = rows.select(
            "url", F.when(goes, F.col("__to")).otherwise(F.col("final_url")).alias("final_url"),
            F.when(goes, F.array_append("__chain", F.col("__to"))).otherwise(F.col("__chain")).alias("__chain"), error.alias("error"),
        )
    return rows.drop("__chain")
