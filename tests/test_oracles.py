"""Every registered query with SQL gives the rows that DuckDB gives for it on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from traceloom.plans import catalog

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal | float):
        return None if v != v else round(float(v), 8)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    q = db.sql(catalog.ORACLES[name])
    assert sorted(q.columns) == cols
    at = [q.columns.index(c) for c in cols]
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in q.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_run(spark, name):
    assert catalog.QUERIES[name](spark, D).collect() is not None
