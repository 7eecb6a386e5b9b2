"""Crawl-delay schedules and robots rules."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.urls import full_url, host_of

MOST_DELAY_US = 5_000_000
RULES = "struct<rules:array<struct<allow:boolean,path:string,pattern:string>>,crawl_delay_ms:bigint>"


def schedule(arrivals: DataFrame, delay_us: int, key: str, at_us: Column, tie: str, slice_us: int = 3_600_000_000) -> DataFrame:
    """``arrivals`` with ``access_us``: each key's accesses in order, ``delay_us`` apart at least.

    access_n = n * d + max(arrival_i - i * d for i <= n).  Counts and maxima are kept by slice
    of time and carried over slices, so a hot key's arrivals are spread over its slices.
    """
    d = min(delay_us, MOST_DELAY_US)
    rows = arrivals.withColumn("__at", at_us).withColumn("__slice", F.floor(F.col("__at") / slice_us))
    inside = Window.partitionBy(key, "__slice").orderBy("__at", tie)
    rows = rows.withColumn("__n", F.row_number().over(inside).cast("long"))
    rows = rows.withColumn("__lead", F.max(F.col("__at") - F.col("__n") * d).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    slices = rows.groupBy(key, "__slice").agg(F.max("__n").alias("__count"), F.max(F.col("__at") - F.col("__n") * d).alias("__most"))
    earlier = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("__before", F.coalesce(F.sum("__count").over(earlier), F.lit(0)))
    slices = slices.withColumn("__carried", F.max(F.col("__most") - F.col("__before") * d).over(earlier)).drop("__count", "__most")
    joined = rows.join(slices, [key, "__slice"])
    place = F.col("__before") + F.col("__n")
    most = F.greatest(F.col("__lead") - F.col("__before") * d, F.coalesce("__carried", F.col("__lead") - F.col("__before") * d))
    return joined.withColumn("access_us", place * d + most).drop("__at", "__slice", "__n", "__lead", "__before", "__carried")


def robots_group(text: str | None, agent: str) -> tuple[list[tuple[bool, str]], int]:
    """The rules (allow, path) and delay of the agent's group, or else of the group ``*``."""
    groups: dict[str, tuple[list[tuple[bool, str]], list[float]]] = {}
    names: list[str] = []
    open_ = False
    for line in (text or "").lstrip("﻿").splitlines():
        field, _, value = line.partition("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            names = [value.lower()] if not open_ else [*names, value.lower()]
            open_ = True
            groups.setdefault(value.lower(), ([], []))
        elif field in ("allow", "disallow", "crawl-delay"):
            open_ = False
            for name in names:
                rules, delays = groups[name]
                if field == "crawl-delay":
                    if re.fullmatch(r"\d+(\.\d+)?", value):
                        delays.append(float(value))
                elif value:
                    rules.append((field == "allow", value))
    own = [n for n in groups if n != "*" and n and n in agent.lower()]
    rules, delays = groups.get(max(own, key=len) if own else "*", ([], []))
    return rules, int(min(delays[-1] * 1e6, MOST_DELAY_US) / 1000) if delays else 0


def parse_robots(agent: str):
    """Column function: a robots file to its rules for ``agent`` (no file: none, no delay)."""

    @F.pandas_udf(RULES)
    def parsed(text: pd.Series) -> pd.DataFrame:
        found = [robots_group(t if isinstance(t, str) else None, agent) for t in text]
        rules = [[{"allow": a, "path": p, "pattern": pattern_of(p)} for a, p in rules] for rules, _ in found]
        return pd.DataFrame({"rules": rules, "crawl_delay_ms": [delay for _, delay in found]})

    return parsed


def pattern_of(path: str) -> str:
    """A rule's path as a regular expression, for Python and for Java alike."""
    body = ".*".join(re.escape(p) for p in path.removesuffix("$").split("*"))
    return f"(?s)^{body}" + (r"(?!.)" if path.endswith("$") else "")


@lru_cache(maxsize=10_000)
def _compiled(path: str) -> re.Pattern:
    return re.compile(pattern_of(path))


def allowed_by(rules: list[tuple[bool, str]], path: str) -> bool:
    """The longest matching rule decides, allow at equal length; no match allows."""
    hits = [(len(p), allow) for allow, p in rules if _compiled(p).match(path or "/")]
    return max(hits)[1] if hits else True


def robots_allowed(rules: str | Column, path: str | Column) -> Column:
    """``allowed_by`` as a native expression; without rules a path may be fetched."""
    rules, path = (F.col(x) if isinstance(x, str) else x for x in (rules, path))
    path = F.when(path == "", "/").otherwise(F.coalesce(path, F.lit("/")))
    hits = F.transform(F.filter(rules, lambda r: F.rlike(path, r["pattern"])), lambda r: F.struct(F.length(r["path"]).alias("length"), r["allow"].alias("allow")))
    return F.coalesce(F.array_max(hits)["allow"], F.lit(True))


def robots_files(fetches: DataFrame, agent: str) -> DataFrame:
    """host, rules and crawl_delay_ms by each host's newest file.

    ``fetches``: host, fetched_at long, status int (null: no answer), robots_txt.  Any answer but
    a 2xx stands for no file, which allows all.  Of files fetched at one time the least counts.
    """
    newest = fetches.groupBy("host").agg(F.min_by(F.struct("status", "robots_txt"), F.struct(-F.col("fetched_at"), "robots_txt", "status")).alias("file"))
    text = F.when(F.col("file.status").between(200, 299), F.col("file.robots_txt"))
    return newest.select("host", parse_robots(agent)(text).alias("file")).select("host", "file.rules", "file.crawl_delay_ms")


def with_robots(requests: DataFrame, files: DataFrame, url: str = "url") -> DataFrame:
    """``requests`` with robots_allowed and crawl_delay_ms by their host's file; a host without
    one allows all.

    The file's side has one row a host, so a hot host is a skewed left side of a left join, which
    adaptive execution splits, or no shuffle where it finds the files small enough to broadcast.
    """
    full = full_url(F.col(url))
    path = F.regexp_extract(full, r"^https?://[^/?#]*([^?#]*)", 1)
    held = files.select(F.col("host").alias("__host"), F.col("rules").alias("__rules"), F.col("crawl_delay_ms").alias("__delay"))
    joined = requests.join(held, host_of(full) == F.col("__host"), "left")
    return joined.withColumns({"robots_allowed": robots_allowed("__rules", path), "crawl_delay_ms": F.coalesce("__delay", F.lit(0).cast("long"))}).drop("__host", "__rules", "__delay")
