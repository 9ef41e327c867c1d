"""Every registered query against its SQL, at the smallest scale."""

import pytest
from check_oracle import compare, duck

import __spark_entry__ as registered
from fieldseries.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_small, con, name):
    assert compare(QUERIES[name](spark, sf_small), con, ORACLES[name]) is None


def test_entry(spark):
    df = registered.entry(spark)
    assert df.count() == 2 and set(registered.oracle_sql()) <= set(registered.queries())
