"""Every query with an SQL twin gives the same columns, types and values."""

import pytest

import __spark_entry__ as entry_points
from compare import differences, duck
from tillroll.oracles import sql
from tillroll.plans import catalog

# The retail queries; those of other parts have tests of their own.
QUERIES, SQL = catalog.queries(), sql.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_catalogue():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_points.queries())
    assert SQL.items() <= entry_points.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == []


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == [
        "cohort_month",
        "initial_customers",
        "month_offset",
        "active_customers",
        "retention_rate_pct",
    ]
    assert df.count() > 0
