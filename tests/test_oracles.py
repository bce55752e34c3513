"""Every registered query of the engine equals its SQL; those without SQL give rows."""

import pytest

from brindle.plans import registry
from tests.oracle import connect, rows_of, sql_rows


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, small, con, name):
    assert rows_of(registry.QUERIES[name](spark, small)) == sql_rows(con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_rows(spark, small, name):
    df = registry.QUERIES[name](spark, small)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
