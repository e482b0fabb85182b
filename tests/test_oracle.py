"""Every query with SQL gives what an independent engine gives; the others give rows of a fixed schema."""

import glob
import os

import pytest
from conftest import TABLES

from attestry.plans.queries import QUERIES, SQL


def _plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, TABLES)
    rows, columns = df.collect(), sorted(df.columns)
    assert len(set(columns)) == len(columns)
    if name in SQL:
        other = duck.execute(SQL[name])
        names = [d[0] for d in other.description]
        assert sorted(names) == columns
        want = sorted("|".join(_plain(r[names.index(c)]) for c in columns) for r in other.fetchall())
        assert sorted("|".join(_plain(r[c]) for c in columns) for r in rows) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
