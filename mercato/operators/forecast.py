"""Forecasting as grouped Spark jobs (F-*).

Model (after Taylor & Letham, "Forecasting at Scale", 2018): additive
  y(t) = trend(t) + weekly(t) [+ yearly(t)]
  trend: piecewise linear, 25 potential changepoints placed on the first 80 %
         of the history rows, slope changes δ_j
  seasonality: Fourier terms, weekly order 3 (P = 7), yearly order 10 (P = 365.25)
The paper's Laplace prior on δ and its sampled intervals are replaced by
Gaussian priors, so the MAP fit is one closed-form ridge solve per series:
  minimise ‖y − Xβ‖² + σ² (Σ δ²/cps² + Σ s²/sps² + (k² + m²)/5²)
with σ² estimated by a first pass.  This is an approximation of the published
model; its numbers are not those of any particular library.

Spark shape
  * a *series* is (series_key, ds, y), one row per day.  Its fit needs XᵀX, Xᵀy and
    yᵀy only: every batch of rows gives partial sums of these products, which an
    aggregate adds up, so no series' days meet in one task;
  * one row per series then holds everything that a solve needs; the 24 grid points
    are solved from the same sums, and scored by a join of the test rows with the
    coefficients;
  * a fitted model is a row of coefficients; forecasting from it is Spark SQL
    (higher-order functions over the coefficient arrays);
  * the band of a future day is the 10 % to 90 % span of simulated paths: new trend
    changes as frequent and as large as the fitted ones, and noise, drawn from hashes
    of (seed, series, path, day), so it widens with the horizon and does not depend on
    how rows are partitioned.  Past days have the noise's band, ±1.2816·σ̂.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.keys import uniform
from mercato.operators.aggregates import forecast_error
from mercato.session import ship_package

# --- fixed values (model configuration) ---
GRID_CPS = (0.001, 0.01, 0.05, 0.1, 0.3, 0.5)      # changepoint prior scales
GRID_SPS = (0.01, 0.1, 1.0, 5.0)                   # seasonality prior scales
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
WEEKLY_ORDER, WEEKLY_PERIOD = 3, 7.0
YEARLY_ORDER, YEARLY_PERIOD = 10, 365.25
TRAIN_SHARE = 0.8
HORIZON = 30
BAND_Z = 1.2816                                     # two-sided 80 % normal interval
BAND = (0.1, 0.9)                                   # the same as quantiles of simulated paths
LINEAR_BAND = (0.85, 1.15)                          # fallback projection band
LINEAR_MIN_ROWS = 7
# ------------------------------------------

SAMPLES, SEED = 300, 42                             # simulated paths per series
EPOCH = "1970-01-01"
FIT_SCHEMA = T.StructType([
    T.StructField("series_key", T.StringType()), T.StructField("cps", T.DoubleType()),
    T.StructField("sps", T.DoubleType()), T.StructField("yearly", T.BooleanType()),
    T.StructField("t0", T.LongType()), T.StructField("t_span", T.DoubleType()),
    T.StructField("y_scale", T.DoubleType()), T.StructField("sigma", T.DoubleType()),
    T.StructField("n_train", T.LongType()), T.StructField("last_ds", T.DateType()),
    T.StructField("changepoints", T.ArrayType(T.DoubleType())),
    T.StructField("coef", T.ArrayType(T.DoubleType())),
])


# ---------------------------------------------------------------- numpy core
def _fourier(days: np.ndarray, period: float, order: int) -> np.ndarray:
    a = 2.0 * math.pi * np.outer(days, np.arange(1, order + 1)) / period
    return np.stack([np.sin(a), np.cos(a)], 2).reshape(len(days), -1)


def design(days: np.ndarray, t0: float, t_span: float, cps: np.ndarray, yearly: bool) -> np.ndarray:
    """One row per day: level, slope, slope changes, weekly (and yearly) terms."""
    t = (days - t0) / t_span
    parts = [np.ones_like(t)[:, None], t[:, None], np.maximum(t[:, None] - cps[None, :], 0.0), _fourier(days, WEEKLY_PERIOD, WEEKLY_ORDER)]
    return np.hstack(parts + ([_fourier(days, YEARLY_PERIOD, YEARLY_ORDER)] if yearly else []))


def solve(products: np.ndarray, n: int, n_changes: int, cps_scale: float, sps_scale: float) -> tuple[np.ndarray, float]:
    """(coefficients, σ) from the products [X y]ᵀ[X y] of a series of n rows."""
    if n < 2:
        raise ValueError("a fit needs two days or more")
    m = int(round(math.sqrt(len(products))))
    both = np.asarray(products, float).reshape(m, m)
    xx, xy, yy = both[:-1, :-1], both[:-1, -1], both[-1, -1]
    prior = np.concatenate([[1 / 25.0, 1 / 25.0], np.full(n_changes, 1 / cps_scale ** 2), np.full(m - 3 - n_changes, 1 / sps_scale ** 2)])
    sigma2 = 1.0
    for _ in range(2):                       # pass 1: unit noise; pass 2: estimated noise
        beta = np.linalg.solve(xx + sigma2 * np.diag(prior), xy)
        sigma2 = max(float(yy - 2 * beta @ xy + beta @ xx @ beta) / max(n - 1, 1), 1e-12)
    return beta, math.sqrt(sigma2)


# ---------------------------------------------------------------- DataFrame operators
def prepare_series(series: DataFrame, key: str | Column = "overall", ds: str = "sale_date",
                   y: str = "total_revenue") -> DataFrame:
    """F-01: (series_key, ds DATE, y DOUBLE)."""
    k = key if isinstance(key, Column) else F.lit(key)
    return series.select(k.cast("string").alias("series_key"), F.col(ds).cast("date").alias("ds"),
                         F.col(y).cast("double").alias("y"))


def chrono_split(series: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """F-02: first floor(share·n) rows of each series are train, the rest test."""
    w = Window.partitionBy("series_key")
    rn = F.row_number().over(w.orderBy("ds"))
    n = F.count(F.lit(1)).over(w)
    return series.select("*", F.when(rn <= F.floor(n * share), "train").otherwise("test").alias("split"))


def param_grid(spark: SparkSession, yearly: bool = False) -> DataFrame:
    rows = [(i, c, s, yearly) for i, (c, s) in enumerate((c, s) for c in GRID_CPS for s in GRID_SPS)]
    return spark.createDataFrame(rows, "grid_index int, cps double, sps double, yearly boolean")


SCORE_SCHEMA = "series_key string, grid_index int, cps double, sps double, mae double, ok boolean"


def _day(ds: str = "ds") -> Column:
    return F.datediff(ds, F.to_date(F.lit(EPOCH)))


def series_frames(series: DataFrame) -> DataFrame:
    """One row per series: n_train, t0, t_span, y_scale, last_ds and the places of its
    potential changepoints, at even ranks over the first days."""
    head = (series.groupBy("series_key")
            .agg(F.count(F.lit(1)).alias("n_train"), F.min(_day()).cast("long").alias("t0"), F.max(_day()).alias("_t1"),
                 F.max("ds").alias("last_ds"), F.max(F.abs("y")).alias("y_scale"))
            .withColumn("t_span", F.greatest(F.col("_t1") - F.col("t0"), F.lit(1)).cast("double"))
            .withColumn("y_scale", F.when(F.col("y_scale") == 0, F.lit(1.0)).otherwise(F.col("y_scale"))).drop("_t1"))
    first = F.floor(F.col("n_train") * CHANGEPOINT_RANGE)
    k = F.least(F.lit(N_CHANGEPOINTS), first - 1).cast("int")
    ranks = F.when(k > 0, F.transform(F.sequence(F.lit(1), k), lambda j: F.bround(j * ((first - 1) / k)).cast("int")))
    at = head.select("series_key", "t0", "t_span", F.explode(ranks).alias("_rank"))
    w = Window.partitionBy("series_key").orderBy("ds")             # a series has one row per day
    placed = series.select("series_key", _day().alias("_d"), (F.row_number().over(w) - 1).alias("_rank"))
    found = (placed.join(at, ["series_key", "_rank"])
             .groupBy("series_key").agg(F.sort_array(F.collect_list((F.col("_d") - F.col("t0")) / F.col("t_span"))).alias("changepoints")))
    none = F.array().cast("array<double>")
    return head.join(found, "series_key", "left").withColumn("changepoints", F.coalesce("changepoints", none))


def _partial_products(yearly: bool):
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, part in pdf.groupby("series_key", sort=False):
                one = part.iloc[0]
                x = design(part._d.to_numpy(float), one.t0, one.t_span, np.asarray(one.changepoints, float), yearly)
                both = np.column_stack([x, part.y.to_numpy(float) / one.y_scale])
                rows.append((key, (both.T @ both).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["series_key", "products"])
    return sums


def normal_equations(series: DataFrame, yearly: bool) -> DataFrame:
    """`series_frames` with `products`, the entries of [X y]ᵀ[X y] by row: partial sums
    of every batch of days, added up by an aggregate."""
    ship_package(series.sparkSession)
    frames = series_frames(series)
    rows = series.join(frames.select("series_key", "t0", "t_span", "y_scale", "changepoints"), "series_key")
    part = (rows.select("series_key", _day().alias("_d"), "y", "t0", "t_span", "y_scale", "changepoints")
            .mapInPandas(_partial_products(yearly), "series_key string, products array<double>"))
    cells = part.select("series_key", F.posexplode("products").alias("i", "v")).groupBy("series_key", "i").agg(F.sum("v").alias("v"))
    sums = cells.groupBy("series_key").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("c"))
    return frames.join(sums.select("series_key", F.col("c.v").alias("products")), "series_key")


def _solved(points: list[tuple] | None):
    """Models of rows of `normal_equations`: for each of `points` (grid_index, cps, sps), or
    for the row's own cps and sps.  A fit that fails has no coefficients."""
    def models(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                for index, cps, sps in points or [(0, r.cps, r.sps)]:
                    try:
                        coef, sigma = solve(r.products, r.n_train, len(r.changepoints), cps, sps)
                        coef = coef.tolist() if np.isfinite(coef).all() else None
                    except Exception:  # noqa: BLE001 — one bad series or point must not fail the others
                        coef, sigma = None, None
                    rows.append((r.series_key, index, float(cps), float(sps), r.t0, r.t_span, r.y_scale, sigma, r.n_train, r.last_ds,
                                 list(r.changepoints), coef))
            yield pd.DataFrame(rows, columns=[f.name for f in SOLVED_SCHEMA])
    return models


SOLVED_SCHEMA = T.StructType([FIT_SCHEMA["series_key"], T.StructField("grid_index", T.IntegerType()),
                              *[f for f in FIT_SCHEMA if f.name not in ("series_key", "yearly")]])


def grid_scores(split_series: DataFrame, grid: DataFrame) -> DataFrame:
    """F-04 (scoring): all grid points of a series are solved from the same sums; the
    test rows meet the coefficients in a join.  A point without a score has ok = false."""
    points = [(r.grid_index, r.cps, r.sps) for r in grid.collect()]
    yearly = bool(grid.first().yearly)
    train, test = (split_series.where(F.col("split") == part) for part in ("train", "test"))
    models = normal_equations(train, yearly).mapInPandas(_solved(points), SOLVED_SCHEMA).where("coef is not null")
    error = F.abs(F.col("y") - yhat_expr(F.col("ds"), yearly))
    mae = (test.select("series_key", "ds", "y").join(models, "series_key").groupBy("series_key", "grid_index").agg(F.avg(error).alias("mae")))
    every = split_series.select("series_key").distinct().crossJoin(F.broadcast(grid.select("grid_index", "cps", "sps")))   # fixed rows
    scored = every.join(mae, ["series_key", "grid_index"], "left")
    return scored.select("series_key", "grid_index", "cps", "sps", "mae", (F.col("mae").isNotNull() & ~F.isnan("mae")).alias("ok"))


def best_params(scores: DataFrame) -> DataFrame:
    """F-04 (selection): minimum test MAE per series; the first grid point wins ties.
    A series with no successful fit has no row (callers treat that as an error)."""
    return (scores.where("ok").groupBy("series_key")
            .agg(F.min_by(F.struct("cps", "sps", "grid_index", "mae"),
                          F.struct("mae", "grid_index")).alias("b"))
            .select("series_key", "b.cps", "b.sps", "b.grid_index", F.col("b.mae").alias("grid_mae")))


def fit_models(series: DataFrame, params: DataFrame, yearly: bool, rows: str | None = None) -> DataFrame:
    """F-03/F-05/F-06: fit one model per series with its chosen parameters (one row
    per series).  `rows='train'` fits on the training rows only (needs a `split`
    column).  A series whose fit fails has no row; `unfitted` names it."""
    s = series.where(F.col("split") == rows) if rows else series
    known = normal_equations(s.select("series_key", "ds", "y"), yearly).join(params.select("series_key", "cps", "sps"), "series_key")
    out = known.mapInPandas(_solved(None), SOLVED_SCHEMA).where("coef is not null").withColumn("yearly", F.lit(yearly))
    return out.select(*[f.name for f in FIT_SCHEMA])


def unfitted(series: DataFrame, models: DataFrame) -> DataFrame:
    """The series that have no model, because their fit failed or no grid point succeeded."""
    return series.select("series_key").distinct().join(models.select("series_key"), "series_key", "left_anti")


def yhat_expr(ds: Column, yearly: bool) -> Column:
    """Model value at `ds` from the coefficient columns of FIT_SCHEMA — JVM-side."""
    d = F.datediff(ds, F.to_date(F.lit(EPOCH))).cast("double")
    t = (d - F.col("t0")) / F.col("t_span")
    coef, cps = F.col("coef"), F.col("changepoints")
    ncp = F.size(cps)
    idx = F.when(ncp > 0, F.sequence(F.lit(0), ncp - 1)).otherwise(F.array().cast("array<int>"))
    hinge = F.aggregate(idx, F.lit(0.0), lambda acc, j: acc + F.element_at(coef, j + 3)
                        * F.greatest(t - F.element_at(cps, j + 1), F.lit(0.0)))
    trend = coef[0] + coef[1] * t + hinge
    off = 2 + ncp
    weekly = _dyn_fourier(coef, off, WEEKLY_ORDER, WEEKLY_PERIOD, d)
    total = trend + weekly
    if yearly:
        total = total + _dyn_fourier(coef, off + 2 * WEEKLY_ORDER, YEARLY_ORDER, YEARLY_PERIOD, d)
    return total * F.col("y_scale")


def _dyn_fourier(coef: Column, offset: Column, order: int, period: float, d: Column) -> Column:
    """Fourier sum whose coefficient offset is a column (depends on #changepoints)."""
    out = None
    for n in range(1, order + 1):
        i = offset + 2 * (n - 1) + 1                  # element_at is 1-based
        a = F.lit(2 * math.pi * n / period) * d
        term = F.element_at(coef, i) * F.sin(a) + F.element_at(coef, i + 1) * F.cos(a)
        out = term if out is None else out + term
    return out


def simulated_band(future: DataFrame, yhat: Column, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """(series_key, ds, yhat_lower, yhat_upper) of `future`: rows of models with every
    day `ds` after `last_ds`, one by one.  Path by path, a day changes the slope with
    the fitted changepoints' frequency, by a Laplace step of their mean size."""
    n = F.size("changepoints")
    size = F.when(n > 0, F.aggregate(F.slice("coef", F.lit(3), n), F.lit(0.0), lambda a, d: a + F.abs(d)) / n).otherwise(0.0)
    t = (_day().cast("double") - F.col("t0")) / F.col("t_span")
    rows = future.select("series_key", "ds", yhat.alias("yhat"), t.alias("t"), F.least(n / F.col("t_span"), F.lit(1.0)).alias("often"),
                         size.alias("size"), "sigma", "y_scale", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("path"))
    u = lambda what: uniform(seed, F.col("series_key"), F.col("path"), F.col("ds"), F.lit(what))
    away = u("step") - 0.5
    step = -F.col("size") * F.signum(away) * F.log(F.greatest(1 - 2 * F.abs(away), F.lit(1e-300)))
    normal = F.sqrt(-2 * F.log(F.greatest(u("radius"), F.lit(1e-300)))) * F.cos(2 * math.pi * u("angle"))
    rows = rows.withColumn("step", F.when(u("change") < F.col("often"), step).otherwise(0.0)).withColumn("noise", F.col("sigma") * normal)
    w = Window.partitionBy("series_key", "path").orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)     # at most the horizon
    bend = F.col("t") * F.sum("step").over(w) - F.sum(F.col("step") * F.col("t")).over(w)
    rows = rows.select("series_key", "ds", (F.col("yhat") + (bend + F.col("noise")) * F.col("y_scale")).alias("v"))
    span = rows.groupBy("series_key", "ds").agg(F.percentile("v", F.array(*[F.lit(q) for q in BAND])).alias("q"))
    return span.select("series_key", "ds", F.col("q")[0].alias("yhat_lower"), F.col("q")[1].alias("yhat_upper"))


def _ahead(models: DataFrame, until: Column) -> DataFrame:
    """The models with every day after their last one, up to `until`."""
    return models.where(until > F.col("last_ds")).select("*", F.explode(F.sequence(F.date_add("last_ds", 1), until)).alias("ds"))


def forecast(models: DataFrame, history: DataFrame | None = None, horizon: int = HORIZON,
             yearly: bool = True, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """F-07: history dates (if given) plus `horizon` future days per series with
    yhat and the 80 % band.  The future spine is generated from each model's
    last date — bounded by the horizon."""
    yh = yhat_expr(F.col("ds"), yearly)
    fut = _ahead(models, F.date_add("last_ds", horizon))
    out = (fut.select("series_key", "ds", yh.alias("yhat")).join(simulated_band(fut, yh, samples, seed), ["series_key", "ds"])
           .withColumn("is_future", F.lit(True)))
    if history is not None:
        h = history.select("series_key", "ds").join(models, "series_key")
        band = F.lit(BAND_Z) * F.col("sigma") * F.col("y_scale")
        past = h.select("series_key", "ds", yh.alias("yhat"), (yh - band).alias("yhat_lower"), (yh + band).alias("yhat_upper"),
                        (F.col("ds") > F.col("last_ds")).alias("is_future"))
        out = past.unionByName(out)
    return out


def interval_coverage(split_series: DataFrame, best: DataFrame, yearly: bool = False, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """Per series the share of test days inside the band that its training rows
    forecast (0.8 is aimed at), and the band's mean width over the first and last
    thirty of them."""
    test = split_series.where(F.col("split") == "test").select("series_key", "ds", "y")
    last = test.groupBy("series_key").agg(F.max("ds").alias("until"), F.min("ds").alias("since"))
    m = fit_models(split_series, best, yearly, rows="train").join(last, "series_key")
    fut = _ahead(m, F.col("until"))
    band = simulated_band(fut, yhat_expr(F.col("ds"), yearly), samples, seed)
    wide = F.col("yhat_upper") - F.col("yhat_lower")
    got = test.join(band, ["series_key", "ds"]).join(last, "series_key")
    return got.groupBy("series_key").agg(
        F.count(F.lit(1)).alias("n_test"), F.avg(F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper")).cast("int")).alias("coverage"),
        F.avg(F.when(F.datediff("ds", "since") < 30, wide)).alias("width_first"), F.avg(F.when(F.datediff("until", "ds") < 30, wide)).alias("width_last"))


def future_only(fc: DataFrame) -> DataFrame:
    """P-08: forecast rows after the last actual date."""
    return fc.where("is_future")


def evaluate_best(split_series: DataFrame, best: DataFrame, yearly: bool = False) -> tuple[DataFrame, DataFrame]:
    """F-05: refit the best parameters on train, predict test; returns (pairs, metrics)."""
    m = fit_models(split_series, best, yearly, rows="train")
    te = split_series.where(F.col("split") == "test").join(m, "series_key")
    pairs = te.select("series_key", "ds", "y", yhat_expr(F.col("ds"), yearly).alias("yhat"))
    return pairs, forecast_error(pairs, keys=("series_key",))


def linear_projection(series: DataFrame, horizon: int = HORIZON, keys: tuple[str, ...] = ()) -> DataFrame:
    """F-08: fallback when no model exists and the series has ≥ 7 rows.

    r30 = 30-row rolling mean (partial windows allowed); level = last r30;
    slope = (last r30 − first r30 of the last 30 rows) / max(rows − 1, 1) —
    an endpoint slope, not least squares; band ×0.85 / ×1.15."""
    w = Window.partitionBy(*keys).orderBy("sale_date")
    r30 = (F.sum("_rev").over(w.rowsBetween(-29, 0)).cast("double") / F.count(F.lit(1)).over(w.rowsBetween(-29, 0))
           if "_rev" in series.columns else F.avg("total_revenue").over(w.rowsBetween(-29, 0)))
    s = series.select(*keys, "sale_date", r30.alias("r30"),
                      F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("sale_date"))).alias("_back"),
                      F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    tail = s.where(F.col("_back") <= 30)
    g = (tail.groupBy(*keys).agg(F.max_by("r30", "sale_date").alias("level"),
                                 F.min_by("r30", "sale_date").alias("first_r30"),
                                 F.count(F.lit(1)).alias("_w"), F.max("sale_date").alias("last_date"),
                                 F.max("_n").alias("_n"))
         .where(F.col("_n") >= LINEAR_MIN_ROWS))
    g = g.select(*keys, "last_date", "level",
                 ((F.col("level") - F.col("first_r30")) / F.greatest(F.col("_w") - 1, F.lit(1))).alias("slope"))
    out = g.select(*keys, "last_date", "level", "slope",
                   F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    fv = F.col("level") + F.col("slope") * F.col("step")
    return out.select(*keys, F.date_add("last_date", F.col("step")).alias("ds"), "step", fv.alias("yhat"),
                      (fv * LINEAR_BAND[0]).alias("yhat_lower"), (fv * LINEAR_BAND[1]).alias("yhat_upper"))


def day_forecast_table(fc: DataFrame) -> DataFrame:
    """F-09: future rows formatted for display."""
    def money(c):
        return F.concat(F.lit("$"), F.format_number(F.round(c, 0), 0))
    return (future_only(fc).orderBy("series_key", "ds")
            .select("series_key", F.date_format("ds", "yyyy-MM-dd").alias("Date"), money(F.col("yhat")).alias("Forecast"),
                    money(F.col("yhat_lower")).alias("Lower (80% CI)"),
                    money(F.col("yhat_upper")).alias("Upper (80% CI)")))


def forecast_vs_history(history: DataFrame, fc: DataFrame) -> DataFrame:
    """F-10: actuals with 7/30-row rolling means, and future forecast rows, on one timeline."""
    w = Window.partitionBy("series_key").orderBy("ds")
    h = history.select("series_key", "ds", "y",
                       F.avg("y").over(w.rowsBetween(-6, 0)).alias("r7"),
                       F.avg("y").over(w.rowsBetween(-29, 0)).alias("r30"),
                       F.lit(None).cast("double").alias("yhat"), F.lit(None).cast("double").alias("yhat_lower"),
                       F.lit(None).cast("double").alias("yhat_upper"))
    f = future_only(fc).select("series_key", "ds", F.lit(None).cast("double").alias("y"),
                               F.lit(None).cast("double").alias("r7"), F.lit(None).cast("double").alias("r30"),
                               "yhat", "yhat_lower", "yhat_upper")
    return h.unionByName(f)


def train(spark: SparkSession, series: DataFrame) -> dict[str, DataFrame]:
    """The retrain job: split → grid → best → evaluate → final fit (yearly on).

    The split series (bounded: days × series) and the chosen parameters feed
    several later steps, so both are checkpointed to the shared
    `spark.checkpoint.dir`: the input aggregation and the grid run once, and a
    lost executor does not re-run them."""
    from mercato.session import checkpoint_dir
    checkpoint_dir(spark)
    split = chrono_split(series).checkpoint()
    if split.isEmpty():
        raise ValueError("there is no day to train on")
    scores = grid_scores(split, param_grid(spark, yearly=False)).checkpoint()
    best = best_params(scores)
    if best.isEmpty():
        raise ValueError("no grid point could be fitted")
    pairs, metrics = evaluate_best(split, best, yearly=False)
    final = fit_models(split.drop("split"), best, yearly=True)
    return {"split": split, "scores": scores, "best": best, "pairs": pairs, "metrics": metrics, "final": final}
