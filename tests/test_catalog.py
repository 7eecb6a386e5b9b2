import pytest

from pagewright.plans import catalog
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf, name):
    compare(spark, sf, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_crawl_reaches_every_seed_once(spark, sf):
    rows = catalog.QUERIES["crawl_bfs"](spark, sf).collect()
    seeds = {r["url"] for r in catalog.pages(spark, sf).select("url").collect()}
    assert {r["url"] for r in rows if r["step"] == 0} == seeds
    assert len({r["url"] for r in rows}) == len(rows)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["domain", "n"]
