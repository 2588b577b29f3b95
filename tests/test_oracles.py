"""Every registered query with SQL of its own against DuckDB on the smallest tables."""

import pytest

from siftwell.queries import ORACLES, QUERIES
from siftwell.queries.base import TABLES
from tests.compare import duck, rows

SF = "/root/testdata/sf0.001"
#: Over 200 documents these find nothing.
MAY_BE_EMPTY = {"text_leak"}


@pytest.fixture(scope="module")
def con():
    return duck(SF, TABLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got) or name in MAY_BE_EMPTY


def test_every_query_without_sql_runs(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
