"""Every registered query with SQL gives the same rows as DuckDB."""

import pytest
from conftest import SF, multiset, oracle

from meterflow.jobs import queries as q


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_equals_sql(spark, name):
    assert multiset(q.QUERIES[name](spark, SF).toPandas()) == multiset(oracle(q.SQL[name]))


def test_all_queries_have_sql():
    assert set(q.QUERIES) == set(q.SQL)
