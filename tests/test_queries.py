"""Every registered query runs, and equals its SQL where it has one."""

import pytest

import tidemark.plans  # noqa: F401
from tests.compare import assert_equal, connect
from tidemark.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, con, name):
    assert_equal(QUERIES[name](spark, sf), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"u15_u16_direction_model", "u17_walk_forward_model"}))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
