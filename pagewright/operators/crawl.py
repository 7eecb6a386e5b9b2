"""Supersteps over a table of fetched pages: frontier, extraction, enqueueing, until nothing is left."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.urls import full_url
from pagewright.operators.extract import extract_pages, link_rows
from pagewright.operators.frontier import enqueue_links, mark_visited, unvisited, visit_counts
from pagewright.session import drop, staged


def crawl(pages: DataFrame, seeds: DataFrame, most_steps: int | None = None) -> DataFrame:
    """url and step of every URL taken from the frontier, seeds at step 0.

    It ends where no link leads to a URL not yet visited, which comes as pages are finite, or
    after ``most_steps``.  Each step ends in a written table, so lineage stays short and a lost executor costs a read.
    """
    spark = pages.sparkSession
    frontier = staged(seeds.select(full_url(F.col("url")).alias("url")).distinct(), "frontier")
    visited = frontier.limit(0)
    counts = spark.createDataFrame([], "domain string, n long")
    taken, older = [], []
    for step in itertools.count():
        if step == most_steps or frontier.isEmpty():
            break
        taken.append(frontier.select("url", F.lit(step).alias("step")))
        visited = staged(mark_visited(visited, frontier), "visited")
        counts = staged(visit_counts(visited), "visits")
        drop(*older)
        older = [visited, counts]
        fetched = pages.withColumn("url", full_url(F.col("url"))).join(frontier, "url", "left_semi")
        links = link_rows(extract_pages(fetched, fields=("internal_links", "external_links")))
        found = enqueue_links(links, fetched, visited, counts)
        frontier = staged(unvisited(found.select(F.col("link").alias("url")).distinct(), visited), "frontier")
    drop(*older)
    result = taken[0] if taken else frontier.select("url", F.lit(0).alias("step"))
    for more in taken[1:]:
        result = result.unionByName(more)
    return result
