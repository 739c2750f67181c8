"""Every query of the catalog against its SQL on DuckDB, over the smallest tables."""

import pytest

from gridloom import catalog

from .oracle import compare, connect

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, con, name):
    assert compare(spark, sf, QUERIES[name], SQL[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    """Queries without SQL: rows with values, and the same ones again."""
    rows = [sorted(map(repr, QUERIES[name](spark, sf).collect())) for _ in range(2)]
    assert rows[0] and rows[0] == rows[1]


def test_entry_module():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
