"""Aggregations: dashboard KPIs, breakdowns, resampling and profiling (A-*).

Money totals sum the exact decimal revenue and are cast to DOUBLE once.
Averages of money are exact sums divided by counts.  Quantiles use Spark's
exact `percentile` (linear interpolation between order statistics, as
pandas' default); it is computed per group on already-aggregated day rows, so
the sort it needs is bounded by days per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.money import exact_line_revenue
from mercato.operators.series import EXACT

# --- fixed values ---
FALLBACK_RANGE = ("1996-07-04", "1998-05-06")   # default date range when no positive day exists
IQR_FENCE = 1.5
ERROR_THRESHOLD = 0.30                          # model acceptance: MAE <= 30 % of mean actual
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
# --------------------


def _d(v) -> Column:
    return v if isinstance(v, Column) else F.to_date(F.lit(str(v)))


def money(c: Column) -> Column:
    """exact decimal sum → DOUBLE"""
    return F.sum(c).cast("double")


# ------------------------------------------------------------------ fact-level KPIs
def _key_of(v) -> Column:
    return F.date_format(_d(v), "yyyyMMdd").cast("int")


def fact_in_range(fact: DataFrame, dim_date: DataFrame, start, end) -> DataFrame:
    """fact ⋈ dim_date with the inclusive date filter.

    The filter is applied to the (calendar-bounded, broadcast) date dimension
    and, redundantly, to the fact's smart date key: with literal dates that
    second filter is a parquet `PushedFilter`, so a fact clustered or
    partitioned by date key is read only for the range."""
    d = F.broadcast(dim_date.select("date_key", "full_date")
                    .where(F.col("full_date").between(_d(start), _d(end))))
    f = fact.where(F.col("date_key").between(_key_of(start), _key_of(end)))
    return f.join(d, "date_key")


def kpi_overview(fact: DataFrame, dim_date: DataFrame, start, end) -> DataFrame:
    """A-02: revenue, distinct orders, AOV — 0 (not NULL) on an empty range."""
    f = fact_in_range(fact, dim_date, start, end)
    g = f.agg(F.sum(exact_line_revenue()).alias("_r"), F.countDistinct("order_id").alias("total_orders"))
    rev = F.col("_r").cast("double")
    return g.select(F.coalesce(rev, F.lit(0.0)).alias("total_revenue"),
                    F.col("total_orders").cast("bigint").alias("total_orders"),
                    F.coalesce(rev / F.nullif(F.col("total_orders"), F.lit(0)), F.lit(0.0)).alias("aov"))


def date_bounds(wide_exact: DataFrame) -> DataFrame:
    """A-06: first and last day with positive revenue (per-row filter, then min/max)."""
    return (wide_exact.where(F.col("total_revenue") > 0)
            .agg(F.min("sale_date").alias("mn"), F.max("sale_date").alias("mx")))


def default_date_range(wide_exact: DataFrame, start=None, end=None) -> DataFrame:
    """P-09: data-driven bounds, else the fixed fallback; a one-ended range is
    closed with the upper bound."""
    b = date_bounds(wide_exact)
    lo = F.coalesce(F.col("mn"), _d(FALLBACK_RANGE[0])) if start is None else _d(start)
    hi = F.coalesce(F.col("mx"), _d(FALLBACK_RANGE[1])) if end is None else _d(end)
    return b.select(lo.alias("start_date"), hi.alias("end_date"))


def revenue_by_day(wide_exact: DataFrame, start, end) -> DataFrame:
    """A-03 with P-01: SUM per date over the inclusive range."""
    return (wide_exact.where(F.col("sale_date").between(_d(start), _d(end)))
            .groupBy("sale_date").agg(money(F.col(EXACT)).alias("revenue")))


def revenue_by_category(wide_exact: DataFrame, start, end) -> DataFrame:
    """A-04: SUM per category over the range (all categories of the spine)."""
    return (wide_exact.where(F.col("sale_date").between(_d(start), _d(end)))
            .groupBy("product_category").agg(F.sum(EXACT).alias(EXACT))
            .select("product_category", F.col(EXACT).cast("double").alias("revenue"), EXACT))


def category_share(wide_exact: DataFrame, start, end) -> DataFrame:
    """A-05: each category's percentage of the range total.

    The window runs over the per-category aggregate (one row per category)."""
    g = revenue_by_category(wide_exact, start, end)
    total = F.sum(EXACT).over(Window.partitionBy())
    return g.select("product_category", "revenue",
                    (F.col(EXACT).cast("double") * 100 / total.cast("double")).alias("share_pct"))


def distinct_categories(dim_products: DataFrame) -> DataFrame:
    """A-07 / P-02."""
    return dim_products.where(F.col("category_name").isNotNull()).select("category_name").distinct()


def max_ids(orders: DataFrame) -> DataFrame:
    """A-08: high-water marks of an order table."""
    return orders.agg(F.max("order_id").alias("max_order_id"), F.max("order_date").alias("max_order_date"))


# ------------------------------------------------------------------ resampling
def week_ending_sunday(c) -> Column:
    """Label of the Monday..Sunday week containing the date: its Sunday."""
    return F.next_day(F.date_sub(c, 1), "Sun")


def weekly_revenue(series: DataFrame) -> DataFrame:
    """A-09: weeks end on and are labelled by Sunday (gap-free input → no empty week is lost)."""
    return (series.groupBy(week_ending_sunday(F.col("sale_date")).alias("week_end"))
            .agg(money(F.col(EXACT)).alias("total_revenue")))


def monthly_revenue(series: DataFrame) -> DataFrame:
    """A-10: calendar months labelled by their last day."""
    return (series.groupBy(F.last_day("sale_date").alias("month_end"))
            .agg(money(F.col(EXACT)).alias("total_revenue")))


# ------------------------------------------------------------------ profiling
def _quartiles(y: str = "total_revenue") -> list[Column]:
    return [F.percentile(y, 0.25).alias("q1"), F.percentile(y, 0.5).alias("median"),
            F.percentile(y, 0.75).alias("q3")]


def exact_std(c: str = EXACT) -> Column:
    """Sample standard deviation from exact sums: Σx and Σx² accumulate as
    DECIMAL (x at 4 places, money precision), combined once in DOUBLE — the
    same value whatever the partitioning (a streaming-moment std is not)."""
    x = F.col(c).cast("decimal(18,4)")
    n = F.count(x)
    s1, s2 = F.sum(x).cast("double"), F.sum(x * x).cast("double")
    var = (s2 - s1 * s1 / n) / (n - 1)
    return F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0))))


def describe_series(series: DataFrame, y: str = "total_revenue") -> DataFrame:
    """A-11: count, mean, sample std, min, quartiles, max (+ non-null count)."""
    exact = EXACT in series.columns
    mean = (F.sum(EXACT).cast("double") / F.count(EXACT)) if exact else F.avg(y)
    std = exact_std() if exact else F.stddev_samp(y)
    return series.agg(F.count(F.lit(1)).alias("n_rows"), F.count(y).alias("count"), mean.alias("mean"),
                      std.alias("std"), F.min(y).alias("min"), *_quartiles(y), F.max(y).alias("max"))


def iqr_outliers(series: DataFrame, y: str = "total_revenue") -> DataFrame:
    """A-12: days above Q3 + 1.5·IQR, with the fences, their count and share (%)."""
    st = series.agg(F.count(F.lit(1)).alias("n_days"),
                    F.percentile(y, 0.25).alias("q1"), F.percentile(y, 0.75).alias("q3"))
    st = st.select("n_days", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"),
                   (F.col("q1") - IQR_FENCE * (F.col("q3") - F.col("q1"))).alias("lower_fence"),
                   (F.col("q3") + IQR_FENCE * (F.col("q3") - F.col("q1"))).alias("upper_fence"))
    out = series.crossJoin(F.broadcast(st)).where(F.col(y) > F.col("upper_fence"))
    n = F.count(F.lit(1)).over(Window.partitionBy())   # over the outlier rows only
    return out.select("sale_date", y, "q1", "q3", "iqr", "lower_fence", "upper_fence",
                      n.alias("n_outliers"), (n * 100.0 / F.col("n_days")).alias("outlier_pct"))


def weekday_index(c) -> Column:
    """Monday = 1 … Sunday = 7."""
    return ((F.dayofweek(c) + 5) % 7 + 1).cast("int")


def weekday_profile(series: DataFrame, y: str = "total_revenue") -> DataFrame:
    """A-13: box statistics per weekday (quartiles, 1.5·IQR whiskers, outliers), Mon..Sun."""
    s = series.select(weekday_index(F.col("sale_date")).alias("weekday_no"),
                      F.date_format("sale_date", "EEEE").alias("weekday"), y)
    st = s.groupBy("weekday_no", "weekday").agg(F.count(F.lit(1)).alias("n_days"), *_quartiles(y))
    st = st.select("*", (F.col("q1") - IQR_FENCE * (F.col("q3") - F.col("q1"))).alias("_lo"),
                   (F.col("q3") + IQR_FENCE * (F.col("q3") - F.col("q1"))).alias("_hi"))
    j = s.join(F.broadcast(st), ["weekday_no", "weekday"])          # ≤ 7 rows
    inside = F.col(y).between(F.col("_lo"), F.col("_hi"))
    return (j.groupBy("weekday_no", "weekday", "n_days", "q1", "median", "q3")
            .agg(F.min(F.when(inside, F.col(y))).alias("whisker_low"),
                 F.max(F.when(inside, F.col(y))).alias("whisker_high"),
                 F.count(F.when(~inside, F.lit(1))).alias("n_outliers"))
            .orderBy("weekday_no"))


def zero_day_share(series: DataFrame, y: str = "total_revenue") -> DataFrame:
    """A-17: share (%) of days with zero revenue."""
    return series.agg(F.count(F.lit(1)).alias("n_days"),
                      F.count(F.when(F.col(y) == 0, F.lit(1))).alias("zero_days"),
                      (F.count(F.when(F.col(y) == 0, F.lit(1))) * 100.0 / F.count(F.lit(1))).alias("zero_pct"))


# ------------------------------------------------------------------ forecast metrics
def forecast_error(pairs: DataFrame, keys: tuple[str, ...] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """A-14: MAE, RMSE, mean actual, acceptance (MAE ≤ 30 % of mean), error rate %."""
    e = F.col(y) - F.col(yhat)
    g = pairs.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                                 F.avg(y).alias("mean_test_revenue"), F.count(F.lit(1)).alias("n_test"))
    return g.select("*", (F.col("mae") <= ERROR_THRESHOLD * F.col("mean_test_revenue")).alias("meets_threshold"),
                    (F.col("mae") * 100 / F.col("mean_test_revenue")).alias("error_rate_pct"))


def forecast_kpis(future: DataFrame, keys: tuple[str, ...] = (), ds: str = "ds", yhat: str = "yhat") -> DataFrame:
    """A-15: horizon total, daily mean, peak day and value (first peak day on ties)."""
    return future.groupBy(*keys).agg(
        F.sum(yhat).alias("forecast_total"), F.avg(yhat).alias("forecast_daily_mean"),
        F.min_by(ds, F.struct(-F.col(yhat), F.col(ds))).alias("peak_date"), F.max(yhat).alias("peak_value"))


def run_kpis(history: DataFrame) -> DataFrame:
    """A-16: number of runs and the latest run's MAE / RMSE (latest by trained_at)."""
    return history.agg(F.count(F.lit(1)).alias("n_runs"),
                       F.max_by("mae", "trained_at").alias("latest_mae"),
                       F.max_by("rmse", "trained_at").alias("latest_rmse"))
