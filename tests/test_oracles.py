"""Every registered query: equal to its SQL counterpart, or at least some rows."""

import pytest

import __spark_entry__ as entry

from .conftest import SF
from .oracle import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
MODEL_QUERIES = {n for n in QUERIES if n not in ORACLES}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(MODEL_QUERIES))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 15
