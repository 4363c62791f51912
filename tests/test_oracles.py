"""Every SQL-checkable registered query equals its DuckDB oracle at sf0.001
(the driver runs the same comparison at sf0.01)."""

import pytest

from plotwise.plans import registry
from tests.oracle_check import compare, duck

registry.load_all()
SQL_QUERIES = sorted(registry.ORACLES)


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_oracle(spark, con, sf_small, name):
    r = compare(spark, con, name, registry.QUERIES[name], registry.ORACLES[name], sf_small)
    assert r["ok"], r
    assert r["types_ok"], r


def test_every_query_has_a_builder():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert len(registry.QUERIES) >= 120
