"""Every query with SQL against that SQL; the others run and have rows."""

import pytest

from lamella.plans.registry import ORACLES, QUERIES

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same):
    assert same(QUERIES[name], ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
