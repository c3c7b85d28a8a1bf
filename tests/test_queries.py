"""Every registered query runs; those with SQL give the same rows as DuckDB."""

from __future__ import annotations

import pytest

from compare import database, same_rows
from skein.plans import catalog

PLANS, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, con, name):
    same_rows(PLANS[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_runs(spark, sf, name):
    assert PLANS[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    assert {"reason", "n"} == set(catalog.flagship(spark, sf).columns)


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(PLANS) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
