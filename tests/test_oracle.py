"""Every registered query of the library proper against its SQL in DuckDB."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from reelspark.plans.registry import ORACLE_SQL, QUERIES


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(map(_norm, v))
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(_norm(r[c]) for c in columns) for r in df.collect()]
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(_norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
