"""The driver contract: entry runs, every query has oracle SQL, a sample agrees with DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from revsift.plans.catalog import QUERIES
from revsift.plans.inputs import TABLES
from revsift.plans.oracle import SQL

SF = "/root/testdata/sf0.001"

def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 12))
    return repr(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 1 and "recall" in df.columns


def test_every_query_has_oracle():
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, cur.fetchall())
