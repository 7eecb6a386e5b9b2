"""Text functions on columns: white space, references, timestamps, native page fields."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewright.functions.html_tree import unescape_ended

# Fixed values.
FILTERED_TERMS = ("xxx", "porn", "sex", "onlyfans", "gore", "hentai")
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:\d{2})$"


@F.pandas_udf(StringType())
def decoded(text: pd.Series) -> pd.Series:
    """Character references decoded by the HTML5 rules."""
    return text.map(lambda x: unescape(x) if isinstance(x, str) else None)


@F.pandas_udf(StringType())
def decoded_ended(text: pd.Series) -> pd.Series:
    """Character references decoded where a semicolon ends them."""
    return text.map(lambda x: unescape_ended(x) if isinstance(x, str) else None)


def stripped(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalised(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def without_raw_text(html: Column) -> Column:
    """The page without comments and without elements whose content is no markup."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript|textarea|iframe|xmp)\b[^>]*>.*?</\1\s*>", "")


def native_titles(html: Column) -> Column:
    """The raw contents of all title elements, one a line."""
    return F.array_join(F.regexp_extract_all(html, F.lit("(?is)<title[^>]*>(.*?)</title>"), F.lit(1)), "\n")


def native_title(html: Column) -> Column:
    """The raw content of the first title element."""
    return F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)


def native_lang(html: Column) -> Column:
    """The html element's lang attribute, null where it has none."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<html\b[^>]*?\slang\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""), F.lit(0))
    first = F.try_element_at(found, F.lit(1))
    return F.regexp_replace(F.regexp_extract(first, r"""(?is)\slang\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)$""", 1), "^[\"']|[\"']$", "")


def is_english(lang: Column) -> Column:
    """No language at all, or one whose first part is en."""
    return lang.isNull() | (F.lower(F.split_part(lang, F.lit("-"), F.lit(1))) == "en")


def has_filtered_term(title: Column) -> Column:
    return F.lower(title).rlike("|".join(FILTERED_TERMS))


def rfc3339(text: Column) -> Column:
    """The instant of a full RFC 3339 timestamp, else null."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(F.regexp_replace(text, ",", ".")))
