"""Every query with SQL gives DuckDB's rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as e

CORE = sorted(n for n in e.core.QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", CORE)
def test_query_is_the_sqls(spark, con, sf_dir, name):
    df = e.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(e.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert e.entry(spark).count() > 0
