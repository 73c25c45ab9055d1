"""Every registered query with SQL gives what DuckDB gives on the same tables; the others run."""

import os

import duckdb
import pytest

from lexmill.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name in catalogue.oracle_sql():
        want = duck.sql(catalogue.oracle_sql()[name])
        assert sorted(df.columns) == sorted(want.columns) and got == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["seg_id", "text", "total"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
