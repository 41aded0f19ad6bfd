"""All queries against their SQL on tables in which one customer, one order and one
product hold a third of the rows, with limits low enough that every such key is
handled as hot. Orders have a time of day, and customers several orders on a day."""

import duckdb
import pytest

from compare import differences, duck
from tillroll.operators import skew
from tillroll.oracles import sql
from tillroll.plans import catalog

QUERIES, SQL = catalog.queries(), sql.oracle_sql()

# the hot order is a completed one; other tables are copied as they are
_SKEW = {
    "orders": """SELECT * REPLACE (
          CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey,
          CAST(date_trunc('week', o_orderdate) AS TIMESTAMP)
            + INTERVAL 1 HOUR * ((o_orderkey * 7919) % 24) AS o_orderdate) FROM t""",
    "lineitem": """SELECT * REPLACE (
          CASE WHEN (l_orderkey + l_linenumber) % 3 = 0
               THEN (SELECT MIN(o_orderkey) FROM o WHERE o_orderstatus = 'F')
               ELSE l_orderkey END
            AS l_orderkey,
          CASE WHEN (l_orderkey + l_linenumber) % 3 = 1 THEN 5 ELSE l_partkey END
            AS l_partkey) FROM t""",
}
_TOUCHED = [
    name
    for name in sorted(SQL)
    if name not in ("product_margin", "products_through_csv", "category_count")
]


@pytest.fixture(scope="module")
def skewed_dir(sf_dir, tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    for name in ("region", "nation", "customer", "part", "orders", "lineitem"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW t AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
        con.execute(f"CREATE VIEW o AS SELECT * FROM read_parquet('{sf_dir}/orders.parquet')")
        sql = _SKEW.get(name, "SELECT * FROM t")
        con.execute(f"COPY ({sql}) TO '{out}/{name}.parquet' (FORMAT parquet)")
    return str(out)


@pytest.fixture(scope="module")
def con(skewed_dir):
    return duck(skewed_dir)


@pytest.mark.parametrize("name", _TOUCHED)
def test_query(spark, con, skewed_dir, name, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 120)
    assert differences(QUERIES[name](spark, skewed_dir), con, SQL[name]) == []
