"""Analytics operators against pandas brute force on a hand-made series, and
the empty-range KPI."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mercato.lake import Lake
from mercato.operators import aggregates as A
from mercato.operators import series as S


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(3)
    days = pd.date_range("1997-03-05", periods=120)
    y = np.where(rng.uniform(size=120) < 0.25, 0.0, rng.uniform(10, 5000, 120).round(2))
    y[7] = 90000.0                                          # an outlier
    return pd.DataFrame({"sale_date": days.date, "total_revenue": y})


@pytest.fixture(scope="module")
def sdf(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn(S.EXACT, F.col("total_revenue").cast("decimal(38,6)"))


def test_resampling_matches_pandas(sdf, pdf):
    p = pdf.set_index(pd.to_datetime(pdf.sale_date)).total_revenue
    weekly = p.resample("W").sum()
    got = {r.week_end: r.total_revenue for r in A.weekly_revenue(sdf).collect()}
    assert {k.date(): round(v, 6) for k, v in weekly.items()} == {k: round(v, 6) for k, v in got.items()}
    monthly = p.resample("ME").sum()
    got = {r.month_end: r.total_revenue for r in A.monthly_revenue(sdf).collect()}
    assert {k.date(): round(v, 6) for k, v in monthly.items()} == {k: round(v, 6) for k, v in got.items()}


def test_describe_and_outliers_match_pandas(sdf, pdf):
    d = pdf.total_revenue.describe()
    r = A.describe_series(sdf).first()
    assert r["count"] == d["count"] and r["min"] == d["min"] and r["max"] == d["max"]
    for ours, theirs in (("mean", "mean"), ("std", "std"), ("q1", "25%"), ("median", "50%"), ("q3", "75%")):
        assert r[ours] == pytest.approx(d[theirs], rel=1e-12)
    q1, q3 = pdf.total_revenue.quantile(0.25), pdf.total_revenue.quantile(0.75)
    upper = q3 + 1.5 * (q3 - q1)
    out = A.iqr_outliers(sdf).collect()
    assert sorted(o.sale_date for o in out) == sorted(pdf[pdf.total_revenue > upper].sale_date)
    assert out[0].outlier_pct == pytest.approx(len(out) / len(pdf) * 100)


def test_weekday_profile_order_and_box(sdf, pdf):
    rows = A.weekday_profile(sdf).collect()
    assert [r.weekday for r in rows] == list(A.WEEKDAYS)
    p = pdf.assign(wd=pd.to_datetime(pdf.sale_date).dt.day_name())
    for r in rows:
        v = p[p.wd == r.weekday].total_revenue
        q1, q3 = v.quantile(0.25), v.quantile(0.75)
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert r.n_days == len(v) and r.median == pytest.approx(v.median())
        assert r.whisker_low == inside.min() and r.whisker_high == inside.max()
        assert r.n_outliers == len(v) - len(inside)


def test_zero_share_and_rolling(sdf, pdf):
    z = A.zero_day_share(sdf).first()
    assert z.zero_pct == pytest.approx((pdf.total_revenue == 0).mean() * 100)
    got = sdf.select("sale_date", S.rolling_mean(sdf, 30).alias("r")).orderBy("sale_date").toPandas().r
    assert np.allclose(got, pdf.total_revenue.rolling(30, min_periods=1).mean())


def test_kpi_on_empty_range_is_zero(spark, sf_small):
    lk = Lake.from_driver(spark, sf_small)
    r = A.kpi_overview(lk.fact_sales, lk.dim_date, "1800-01-01", "1800-12-31").first()
    assert (r.total_revenue, r.total_orders, r.aov) == (0.0, 0, 0.0)
