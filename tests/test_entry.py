import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillon import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    frame = frame[cols].astype(object)
    return sorted(str(tuple(None if v != v else v for v in r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", core.ORACLE_SQL)
def test_query_is_its_sql(spark, sf_dir, oracle, name):
    got, want = core.QUERIES[name](spark, sf_dir).toPandas(), oracle.sql(core.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(entry.__file__)


@pytest.mark.parametrize("copies", [0, 1, 3])
def test_position_among_equal_prices(spark, sf_dir, tmp_path, copies):
    """Copies of the last order's price, under other keys, don't move its place."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT o.* REPLACE (o_orderkey + 1500 * k AS o_orderkey) FROM '{sf_dir}/orders.parquet' o, range({copies}) t(k)) TO '{tmp_path}/orders.parquet'")
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    got = core.QUERIES["position_of_row"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == con.sql(core.ORACLE_SQL["position_of_row"]).fetchall()
