"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return str(v) if isinstance(v, (str, bool)) else repr(round(float(v), 6) + 0.0)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    want = want.project(", ".join(f'"{c}"' for c in columns))
    assert plain(got.select(*(f"`{c}`" for c in columns)).collect()) == plain(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_one_exchange_feeds_the_fit(spark):
    plan = QUERIES["tcev_fit"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_scan_reads_what_it_needs(spark):
    plan = QUERIES["event_date_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan.split("ReadSchema")[1]
