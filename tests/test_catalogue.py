"""Every registered query against its SQL on the smallest tables."""

import pytest
from gate import compare, connect

from tickerloom.catalog import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ok, text = compare(spark, duck, name, QUERIES[name], SQL.get(name), SF)
    assert ok, text
