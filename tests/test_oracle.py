"""A representative subset of registered queries against their DuckDB twins
at sf0.001 (the full set: `python tools/compare.py`)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
import compare as C  # noqa: E402

SUBSET = ["stg_order_details", "dim_products", "fact_sales", "wide_sales_forecast", "kpi_overview",
          "top_customers", "weekday_profile", "describe_series", "incr_fact_sales", "dq_suite",
          "forecast_linear", "category_growth_mom", "screen_sql_log", "synthetic_orders", "synthetic_lines"]


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in C.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SUBSET)
def test_matches_duckdb(spark, sf_small, duck, name):
    df = E.queries()[name](spark, sf_small)
    got = C.rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(E.oracle_sql()[name])
    exp = C.rows_of([d[0] for d in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert got == exp
