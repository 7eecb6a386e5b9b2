import pytest

from pagewright.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf, name):
    compare(spark, sf, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
