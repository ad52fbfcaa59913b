"""Every registered query against its SQL on the small tables; the rest must give rows."""

import pytest

from memspark.plans import all_oracles, all_queries
from tests.compare import connect, diff

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, sf, con):
    assert diff(QUERIES[name](spark, sf), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0
