"""Every core query against its SQL, on the smallest tables."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from strandbase import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return round(float(v), 5) if isinstance(v, (float, Decimal)) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    out = sql.execute(queries.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in out.fetchall()), key=repr)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_flagship(spark):
    assert queries.flagship(spark, SF).count() > 0
