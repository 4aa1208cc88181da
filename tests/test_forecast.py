"""Forecasting: the solver recovers a planted trend and weekly pattern; the
grid picks the lowest MAE (first on ties); the SQL-side predictor equals the
numpy one; the linear fallback equals a pandas brute force."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from mercato.operators import forecast as FC
from mercato.operators import series as S

def fit_series(days, y, cps_scale, sps_scale, yearly):
    """One series in memory: the ridge problem solved from its whole design matrix."""
    days, y = np.asarray(days, float), np.asarray(y, float)
    n, t0, t_span = len(days), days[0], max(days[-1] - days[0], 1.0)
    y_scale = float(np.max(np.abs(y))) or 1.0
    first = int(n * FC.CHANGEPOINT_RANGE)
    k = min(FC.N_CHANGEPOINTS, max(first - 1, 0))
    at = np.round(np.linspace(0, first - 1, k + 1)).astype(int)[1:] if k else np.empty(0, int)
    cps = (days[at] - t0) / t_span
    X, ys, sigma2 = FC.design(days, t0, t_span, cps, yearly), y / y_scale, 1.0
    prior = np.array([1 / 25.0] * 2 + [1 / cps_scale ** 2] * len(cps) + [1 / sps_scale ** 2] * (X.shape[1] - 2 - len(cps)))
    for _ in range(2):
        beta = np.linalg.solve(X.T @ X + sigma2 * np.diag(prior), X.T @ ys)
        sigma2 = max(float(np.sum((ys - X @ beta) ** 2)) / max(n - 1, 1), 1e-12)
    return {"t0": t0, "t_span": t_span, "y_scale": y_scale, "sigma": sigma2 ** 0.5, "changepoints": cps, "coef": beta}


def predict_days(m, days, yearly):
    return FC.design(np.asarray(days, float), m["t0"], m["t_span"], np.asarray(m["changepoints"]), yearly) @ np.asarray(m["coef"]) * m["y_scale"]


def day_numbers(ds):
    return (pd.to_datetime(ds) - pd.Timestamp("1970-01-01")).dt.days.to_numpy()


WEEK = [0.0, 30.0, 25.0, 20.0, 15.0, 10.0, -40.0]


def _planted(n=400, start=dt.date(1997, 1, 1), slope=0.5, level=200.0):
    rows = []
    for i in range(n):
        d = start + dt.timedelta(days=i)
        rows.append(("s1", d, level + slope * i + WEEK[d.weekday()]))
    return rows


@pytest.fixture(scope="module")
def planted(spark):
    return spark.createDataFrame(_planted(), "series_key string, ds date, y double")


def test_solver_recovers_trend_and_weekly():
    rows = _planted()
    days = np.array([(r[1] - dt.date(1970, 1, 1)).days for r in rows])
    y = np.array([r[2] for r in rows])
    m = fit_series(days, y, 0.5, 10.0, yearly=False)
    fut = days[-1] + np.arange(1, 29)
    pred = predict_days(m, fut, False)
    truth = np.array([200 + 0.5 * (len(rows) - 1 + k) + WEEK[(dt.date(1970, 1, 1) + dt.timedelta(days=int(d))).weekday()]
                      for k, d in zip(range(1, 29), fut)])
    assert np.max(np.abs(pred - truth)) < 3.0          # within 3 on values ~400


def test_spark_predictor_matches_numpy(spark, planted):
    params = spark.createDataFrame([("s1", 0.05, 10.0)], "series_key string, cps double, sps double")
    for yearly in (False, True):
        m = FC.fit_models(planted, params, yearly=yearly)
        fc = FC.forecast(m, planted, horizon=10, yearly=yearly).orderBy("ds").toPandas()
        row = m.first().asDict()
        ref = predict_days(row, day_numbers(fc.ds), yearly)
        assert np.max(np.abs(ref - fc.yhat)) < 1e-6
        assert fc.is_future.sum() == 10


def test_chrono_split_and_grid(spark, planted):
    split = FC.chrono_split(planted)
    c = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert c == {"train": 320, "test": 80}
    scores = FC.grid_scores(split, FC.param_grid(spark))
    pdf = scores.toPandas()
    assert len(pdf) == 24 and pdf.ok.all()
    best = FC.best_params(scores).first()
    m = pdf[pdf.mae == pdf.mae.min()].sort_values("grid_index").iloc[0]
    assert best.grid_index == m.grid_index


def test_best_params_first_wins_ties(spark):
    s = spark.createDataFrame([("a", 3, 0.3, 1.0, 5.0, True), ("a", 1, 0.01, 1.0, 5.0, True),
                               ("a", 0, 0.001, 0.01, 9.0, False)], FC.SCORE_SCHEMA)
    assert FC.best_params(s).first().grid_index == 1


def test_linear_projection_brute_force(spark):
    rng = np.random.default_rng(7)
    vals = rng.uniform(0, 100, 45).round(2)
    start = dt.date(1998, 1, 1)
    df = spark.createDataFrame([(start + dt.timedelta(days=i), float(v)) for i, v in enumerate(vals)],
                               "sale_date date, total_revenue double")
    got = FC.linear_projection(df, 30).orderBy("step").toPandas()
    h = pd.Series(vals)
    r30 = h.rolling(30, min_periods=1).mean()
    window = r30.tail(30)
    slope = (window.iloc[-1] - window.iloc[0]) / max(len(window) - 1, 1)
    exp = [r30.iloc[-1] + slope * i for i in range(1, 31)]
    assert np.allclose(got.yhat, exp) and np.allclose(got.yhat_upper, np.array(exp) * 1.15)
    assert got.ds.iloc[0] == start + dt.timedelta(days=45)


def test_linear_projection_needs_seven_rows(spark):
    df = spark.createDataFrame([(dt.date(1998, 1, d), 1.0) for d in range(1, 7)], "sale_date date, total_revenue double")
    assert FC.linear_projection(df).count() == 0


def test_series_filters(spark):
    rows = [(dt.date(1998, 1, d), v) for d, v in [(1, 0.0), (2, 5.0), (3, 0.0), (4, 7.0), (5, 0.0)]]
    s = spark.createDataFrame(rows, "sale_date date, total_revenue double")
    assert [r.sale_date.day for r in S.active_period_calendar(s).orderBy("sale_date").collect()] == [2, 3, 4]
    assert S.positive_days(s).count() == 2 and S.active_period_positive(s, required=True).count() == 2
    with pytest.raises(ValueError, match="no day with revenue"):
        S.active_period_positive(s.where("total_revenue = 0"), required=True)
    gaps = spark.createDataFrame([(dt.date(1998, 1, d),) for d in (1, 2, 5)], "sale_date date")
    assert sorted(r.sale_date.day for r in S.missing_dates(gaps).collect()) == [3, 4]


def test_forecast_outputs(spark, planted):
    params = spark.createDataFrame([("s1", 0.05, 1.0)], "series_key string, cps double, sps double")
    m = FC.fit_models(planted, params, yearly=True)
    fc = FC.forecast(m, planted, horizon=30)
    last = planted.agg({"ds": "max"}).first()[0]
    fut = FC.future_only(fc).orderBy("ds").collect()
    assert len(fut) == 30 and fut[0].ds == last + dt.timedelta(days=1)
    assert all(r.yhat_lower < r.yhat < r.yhat_upper for r in fut)
    five = FC.future_only(FC.forecast(m, None, 5)).count()           # validation: reload-and-predict shape
    assert five == 5
    table = FC.day_forecast_table(fc).collect()
    assert len(table) == 30 and table[0].Date == str(last + dt.timedelta(days=1))
    import re
    assert all(re.fullmatch(r"\$-?\d{1,3}(,\d{3})*", r.Forecast) for r in table)
    both = FC.forecast_vs_history(planted, fc)
    assert both.count() == 400 + 30
    assert both.where("y IS NOT NULL AND yhat IS NULL").count() == 400


def test_one_short_series_does_not_fail_the_others(spark):
    import datetime as dt

    import pytest
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    rows = [("long", day(i), 100.0 + i % 7) for i in range(60)] + [("short", day(0), 5.0)]
    s = spark.createDataFrame(rows, "series_key string, ds date, y double")
    out = FC.train(spark, s)
    assert [r.series_key for r in out["final"].collect()] == ["long"] and out["scores"].count() == 48
    assert [r.series_key for r in FC.unfitted(s, out["final"]).collect()] == ["short"]
    with pytest.raises(ValueError, match="no grid point"):
        FC.train(spark, s.where("series_key = 'short'"))
    with pytest.raises(ValueError, match="no day to train on"):
        FC.train(spark, s.limit(0))


def test_every_registered_series_is_fitted(spark, sf_small):
    from mercato.queries import QUERIES, lake
    keys = {f"category: {r[0]}" for r in lake(spark, sf_small).dim_products.select("category_name").distinct().collect()} | {"overall"}
    fc = QUERIES["forecast_30"](spark, sf_small).toPandas()
    assert set(fc.series_key) == keys and (fc[fc.is_future].groupby("series_key").size() == 30).all()
    assert (fc.yhat_lower <= fc.yhat).all() and (fc.yhat <= fc.yhat_upper).all()


@pytest.fixture(scope="module")
def several(spark):
    """Series of 2 to 500 days, with gaps, noise and a zero series."""
    rng = np.random.default_rng(11)
    rows = []
    for i, n in enumerate((2, 3, 7, 31, 60, 200, 500)):
        day = np.sort(rng.choice(np.arange(10000, 10000 + 2 * n), n, replace=False))
        rows += [(f"s{i}", dt.date(1970, 1, 1) + dt.timedelta(days=int(d)), float(v)) for d, v in
                 zip(day, 100 + 0.1 * (day - 10000) + 20 * np.sin(day) + rng.normal(0, 9, n))]
    rows += [("zero", dt.date(2000, 1, d), 0.0) for d in range(1, 20)]
    return spark.createDataFrame(rows, "series_key string, ds date, y double").repartition(7).cache()


def test_summed_products_give_the_same_fit(spark, several):
    """Partial sums of batches against each series' whole design matrix."""
    params = several.select("series_key").distinct().selectExpr("series_key", "0.05D AS cps", "10D AS sps")
    local = {k: g.sort_values("ds") for k, g in several.toPandas().groupby("series_key")}
    for yearly in (False, True):
        models = {r.series_key: r for r in FC.fit_models(several, params, yearly).collect()}
        assert models.keys() == local.keys()
        for k, g in local.items():
            want, got = fit_series(day_numbers(g.ds), g.y.to_numpy(), 0.05, 10.0, yearly), models[k]
            assert np.allclose(got.changepoints, want["changepoints"], atol=1e-12) and (got.t0, got.t_span, got.n_train) == (want["t0"], want["t_span"], len(g))
            assert np.allclose(got.coef, want["coef"], atol=1e-9) and abs(got.sigma - want["sigma"]) < 1e-9 and got.y_scale == want["y_scale"]


def test_grid_scores_equal_refits(spark, several):
    split = FC.chrono_split(several).cache()
    got = {(r.series_key, r.grid_index): r for r in FC.grid_scores(split, FC.param_grid(spark)).collect()}
    assert len(got) == 24 * 8
    for k, g in split.toPandas().groupby("series_key"):
        tr, te = (g[g.split == part].sort_values("ds") for part in ("train", "test"))
        for i, (c, s) in enumerate((c, s) for c in FC.GRID_CPS for s in FC.GRID_SPS):
            r = got[(k, i)]
            assert (r.cps, r.sps) == (c, s) and r.ok == (len(tr) > 1)
            if r.ok:
                m = fit_series(day_numbers(tr.ds), tr.y.to_numpy(), c, s, False)
                assert abs(r.mae - np.mean(np.abs(te.y - predict_days(m, day_numbers(te.ds), False)))) < 1e-7


def test_band_widens_and_does_not_depend_on_partitions(spark, several):
    rng = np.random.default_rng(12)
    rows = []
    for key in ("a", "b"):                                       # the slope changes every forty days
        y = 300 + np.cumsum(np.repeat(rng.normal(0, 1.5, 10), 40)) + rng.normal(0, 3, 400)
        rows += [(key, dt.date(1997, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)]
    bent = spark.createDataFrame(rows, "series_key string, ds date, y double")
    models = FC.fit_models(bent, bent.select("series_key").distinct().selectExpr("series_key", "0.5D AS cps", "10D AS sps"), False).cache()
    far = FC.forecast(models, None, 200, yearly=False).toPandas().sort_values(["series_key", "ds"])
    again = FC.forecast(models.repartition(5), None, 200, yearly=False).toPandas().sort_values(["series_key", "ds"])
    assert np.allclose(far[["yhat_lower", "yhat_upper"]], again[["yhat_lower", "yhat_upper"]], atol=1e-9) and len(far) == 400
    for _, g in far.groupby("series_key"):
        w = (g.yhat_upper - g.yhat_lower).to_numpy()
        assert w[-30:].mean() > 1.5 * w[:30].mean() and (g.yhat_lower < g.yhat).all() and (g.yhat < g.yhat_upper).all()
    other = FC.forecast(models, None, 5, yearly=False, seed=7).toPandas()
    assert not np.allclose(other.yhat_upper, FC.forecast(models, None, 5, yearly=False).toPandas().yhat_upper)


def test_coverage_of_noise_around_a_line(spark):
    """Noise around a straight line: about 80 % of the test days lie inside the band."""
    rng = np.random.default_rng(5)
    rows = [("n", dt.date(1997, 1, 1) + dt.timedelta(days=i), float(500 + 0.2 * i + rng.normal(0, 10))) for i in range(1000)]
    split = FC.chrono_split(spark.createDataFrame(rows, "series_key string, ds date, y double"))
    best = spark.createDataFrame([("n", 0.001, 0.01)], "series_key string, cps double, sps double")
    r = FC.interval_coverage(split, best).first()
    assert r.n_test == 200 and 0.7 < r.coverage < 0.9 and r.width_last > 0
