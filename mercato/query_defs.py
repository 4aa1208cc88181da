"""Registered queries for the operator inventory, each with its SQL twin.

Dashboard-style queries use the dashboard's default date range: the first to
the last day with positive revenue (P-09), i.e. the whole active period.
The range enters the Spark plan as scalar subqueries, evaluated once.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato import oracle
from mercato.oracle import rev, spark_percentiles
from mercato.operators import aggregates as A
from mercato.operators import joins as J
from mercato.operators import questions as B
from mercato.operators import series as S
from mercato.operators import topk as L
from mercato.functions import keys as K
from mercato.operators import forecast as FC
from mercato.operators import incremental as I
from mercato.operators import quality as Q
from mercato.operators import screening as R
from mercato.operators import synthetic as X
from mercato.plans import gold as G
from mercato.plans.staging import stg_orders as _stg_orders
from mercato.sources import catalog as C
from mercato.sources import runs as RUNS
from mercato.sources.schemas import BRONZE, RUN_RECORD
from mercato.streaming.incremental import land, run_once
from mercato.queries import lake, register

sql = oracle.sql


def _range(lk):
    """(start, end) Columns of the default date range, as scalar subqueries."""
    # one struct-valued subquery used twice: Spark runs it once (subquery reuse)
    b = lk.positive_bounds.select(F.struct(
        F.coalesce("mn", F.to_date(F.lit(A.FALLBACK_RANGE[0]))).alias("s"),
        F.coalesce("mx", F.to_date(F.lit(A.FALLBACK_RANGE[1]))).alias("e"))).scalar()
    return b.getField("s"), b.getField("e")


def _ranged(lk):
    """The wide table beside the default range, and the range's two Columns.  A filter by
    subqueries would reach the fact and part the plan of the table from the range's; so
    both read one aggregate of it."""
    s, e = F.to_date(F.lit(A.FALLBACK_RANGE[0])), F.to_date(F.lit(A.FALLBACK_RANGE[1]))
    b = lk.positive_bounds.select(F.coalesce("mn", s).alias("_start"), F.coalesce("mx", e).alias("_end"))
    return lk.wide_exact.crossJoin(F.broadcast(b)), F.col("_start"), F.col("_end")


def _series(spark, sf_dir):
    return S.daily_series(lake(spark, sf_dir).wide_exact)


def _pub(df: DataFrame) -> DataFrame:
    """drop internal exact columns from a result"""
    return df.drop(S.EXACT)


# ====================================================================== filters (P)
@register("date_range_filter", sql("SELECT * FROM wide_sales_forecast "
                                   "WHERE sale_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"))
def q_date_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = lake(spark, sf_dir).wide_sales_forecast
    return w.where(F.col("sale_date").between(F.to_date(F.lit("1997-01-01")), F.to_date(F.lit("1998-12-31"))))


@register("not_null_filter", sql("SELECT * FROM dim_products WHERE category_name IS NOT NULL"))
def q_not_null_filter(spark, sf_dir):
    return lake(spark, sf_dir).dim_products.where(F.col("category_name").isNotNull())


@register("positive_revenue", sql("SELECT sale_date, CAST(sum(rev_) AS DOUBLE) AS daily_revenue "
                                  "FROM wide_sales_forecast_ WHERE total_revenue > 0 GROUP BY sale_date"))
def q_positive_revenue(spark, sf_dir):
    w = lake(spark, sf_dir).wide_exact
    # per-row filter BEFORE grouping (a day's zero categories are dropped first)
    return (w.where(F.col("total_revenue") > 0).groupBy("sale_date")
            .agg(F.sum(S.EXACT).cast("double").alias("daily_revenue")))


@register("active_period_calendar", sql("SELECT sale_date, total_revenue FROM active_"))
def q_active_period_calendar(spark, sf_dir):
    return _pub(S.active_period_calendar(_series(spark, sf_dir)))


@register("active_period_positive", sql("SELECT sale_date, total_revenue FROM positive_"))
def q_active_period_positive(spark, sf_dir):
    return _pub(S.active_period_positive(_series(spark, sf_dir)))


@register("last_n_days", sql("SELECT p.sale_date, p.total_revenue FROM positive_ p, "
                             "(SELECT max(sale_date) AS mx FROM positive_) b "
                             "WHERE p.sale_date BETWEEN b.mx - INTERVAL 180 DAY AND b.mx + INTERVAL 30 DAY"))
def q_last_n_days(spark, sf_dir):
    return _pub(S.last_n_days(S.positive_days(_series(spark, sf_dir)), 180, 30))


@register("from_date_zoom", sql("SELECT sale_date, total_revenue FROM active_ WHERE sale_date >= DATE '1998-01-01'"))
def q_from_date_zoom(spark, sf_dir):
    return _pub(S.from_date(S.active_period_calendar(_series(spark, sf_dir)), "1998-01-01"))


@register("default_date_range", sql("SELECT start_date, end_date FROM range_"))
def q_default_date_range(spark, sf_dir):
    return A.default_date_range(lake(spark, sf_dir).wide_exact)


# ====================================================================== joins (J)
@register("join_orders_lines", sql(
    "SELECT o.order_id, o.customer_id, o.employee_id, o.order_date, od.product_id, od.quantity, od.unit_price, "
    "od.discount, od.line_revenue FROM stg_orders o JOIN stg_order_details od ON o.order_id = od.order_id"))
def q_join_orders_lines(spark, sf_dir):
    lk = lake(spark, sf_dir)
    return J.join_orders_lines(lk.stg_orders, lk.stg_order_details)


@register("join_left_lookup", sql(
    "SELECT p.product_id, p.product_name, c.category_name, s.company_name AS supplier_name FROM stg_products p "
    "LEFT JOIN stg_categories c ON p.category_id = c.category_id "
    "LEFT JOIN stg_suppliers s ON p.supplier_id = s.supplier_id"))
def q_join_left_lookup(spark, sf_dir):
    lk = lake(spark, sf_dir)
    return J.join_left_lookup(lk.stg_products, lk.stg_categories, lk.stg_suppliers)


@register("join_cross_spine", sql(
    "SELECT d.full_date AS sale_date, d.year, c.product_category FROM dim_date d CROSS JOIN "
    "(SELECT DISTINCT category_name AS product_category FROM dim_products WHERE category_name IS NOT NULL) c"))
def q_join_cross_spine(spark, sf_dir):
    lk = lake(spark, sf_dir)
    return J.join_cross_spine(lk.dim_date, lk.dim_products)


@register("join_spine_fill", sql(
    "SELECT sale_date, year, product_category, total_revenue, total_orders, total_quantity, avg_order_value "
    "FROM filled_"))
def q_join_spine_fill(spark, sf_dir):
    lk = lake(spark, sf_dir)
    spine = J.join_cross_spine(lk.dim_date, lk.dim_products)
    daily = lk.daily_cat.drop(S.EXACT)
    out = J.join_spine_fill(spine, daily)
    return out.select("sale_date", "year", "product_category", "total_revenue",
                      F.col("total_orders").cast("bigint").alias("total_orders"),
                      F.col("total_quantity").cast("bigint").alias("total_quantity"), "avg_order_value")


@register("star_join", sql(
    "SELECT fs.order_id, fs.order_detail_id, dd.full_date, dp.product_name, dp.category_name, dc.company_name, "
    "dc.country, fs.quantity, fs.line_revenue FROM fact_sales fs "
    "JOIN dim_date dd ON fs.date_key = dd.date_key JOIN dim_products dp ON fs.product_key = dp.product_key "
    "JOIN dim_customers dc ON fs.customer_key = dc.customer_key"))
def q_star_join(spark, sf_dir):
    lk = lake(spark, sf_dir)
    return J.star_join(lk.fact_lines, lk.dim_date, lk.dim_products, lk.dim_customers)


def _without_a_country(dim):
    return dim.where(F.col("country") != dim.agg(F.min("country")).scalar())


@register("anti_orphans", sql(
    "SELECT f.* FROM fact_sales f WHERE f.customer_key IS NOT NULL AND NOT EXISTS "
    "(SELECT 1 FROM dim_customers d WHERE d.customer_key = f.customer_key "
    "AND d.country <> (SELECT min(country) FROM dim_customers))"))
def q_anti_orphans(spark, sf_dir):
    """Against parents that lack one country's customers, so that orphans exist."""
    lk = lake(spark, sf_dir)
    return G.with_keys(J.anti_orphans(lk.fact_lines, _without_a_country(lk.dim_customers), "customer_key"))


@register("anti_missing_dates", sql(
    "SELECT CAST(d AS DATE) AS order_date FROM (SELECT unnest(generate_series(CAST(min(order_date) AS TIMESTAMP), "
    "CAST(max(order_date) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM stg_orders) c "
    "WHERE CAST(d AS DATE) NOT IN (SELECT order_date FROM stg_orders WHERE order_date IS NOT NULL)"))
def q_anti_missing_dates(spark, sf_dir):
    return S.missing_dates(lake(spark, sf_dir).stg_orders.select("order_date"), "order_date")


# ====================================================================== aggregates (A)
@register("daily_category_sales", sql(
    "SELECT sale_date, product_category, total_revenue, total_orders, total_quantity, avg_order_value "
    "FROM daily_category_sales"))
def q_daily_category_sales(spark, sf_dir):
    return _pub(lake(spark, sf_dir).daily_cat).select(
        "sale_date", "product_category", "total_revenue", F.col("total_orders").cast("bigint").alias("total_orders"),
        "total_quantity", "avg_order_value")


@register("kpi_overview", sql(
    f"SELECT coalesce(CAST(sum({rev()}) AS DOUBLE), 0.0) AS total_revenue, "
    "CAST(count(DISTINCT order_id) AS BIGINT) AS total_orders, "
    f"coalesce(CAST(sum({rev()}) AS DOUBLE) / NULLIF(count(DISTINCT order_id), 0), 0.0) AS aov FROM fact_range_"))
def q_kpi_overview(spark, sf_dir):
    lk = lake(spark, sf_dir)
    return A.kpi_overview(lk.fact_lines, lk.dim_date, *_range(lk))


@register("daily_revenue", sql(
    "SELECT w.sale_date, CAST(sum(w.rev_) AS DOUBLE) AS revenue FROM wide_sales_forecast_ w, range_ r "
    "WHERE w.sale_date BETWEEN r.start_date AND r.end_date GROUP BY w.sale_date"))
def q_daily_revenue(spark, sf_dir):
    lk = lake(spark, sf_dir)
    return A.revenue_by_day(*_ranged(lk))


@register("revenue_by_category", sql(
    "SELECT w.product_category, CAST(sum(w.rev_) AS DOUBLE) AS revenue FROM wide_sales_forecast_ w, range_ r "
    "WHERE w.sale_date BETWEEN r.start_date AND r.end_date GROUP BY w.product_category"))
def q_revenue_by_category(spark, sf_dir):
    lk = lake(spark, sf_dir)
    return _pub(A.revenue_by_category(*_ranged(lk)))


@register("category_share", sql(
    "SELECT product_category, CAST(r AS DOUBLE) AS revenue, CAST(r AS DOUBLE) * 100 / CAST(sum(r) OVER () AS DOUBLE) "
    "AS share_pct FROM (SELECT w.product_category, sum(w.rev_) AS r FROM wide_sales_forecast_ w, range_ g "
    "WHERE w.sale_date BETWEEN g.start_date AND g.end_date GROUP BY w.product_category) t"))
def q_category_share(spark, sf_dir):
    lk = lake(spark, sf_dir)
    return A.category_share(*_ranged(lk))


@register("date_bounds", sql("SELECT mn, mx FROM bounds_"))
def q_date_bounds(spark, sf_dir):
    return A.date_bounds(lake(spark, sf_dir).wide_exact)


@register("distinct_categories", sql("SELECT DISTINCT category_name FROM dim_products WHERE category_name IS NOT NULL"))
def q_distinct_categories(spark, sf_dir):
    return A.distinct_categories(lake(spark, sf_dir).dim_products)


@register("max_ids", sql("SELECT max(order_id) AS max_order_id, max(order_date) AS max_order_date FROM b_orders"))
def q_max_ids(spark, sf_dir):
    return A.max_ids(lake(spark, sf_dir).bronze["orders"])


@register("weekly_revenue", sql(
    "SELECT CAST(date_trunc('week', sale_date) + INTERVAL 6 DAY AS DATE) AS week_end, "
    "CAST(sum(rev_) AS DOUBLE) AS total_revenue FROM active_ GROUP BY 1"))
def q_weekly_revenue(spark, sf_dir):
    return A.weekly_revenue(S.active_period_calendar(_series(spark, sf_dir)))


@register("monthly_revenue", sql(
    "SELECT last_day(sale_date) AS month_end, CAST(sum(rev_) AS DOUBLE) AS total_revenue FROM active_ GROUP BY 1"))
def q_monthly_revenue(spark, sf_dir):
    return A.monthly_revenue(S.active_period_calendar(_series(spark, sf_dir)))


@register("describe_series", sql(
    "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(total_revenue) AS BIGINT) AS count, "
    "CAST(sum(rev_) AS DOUBLE) / count(rev_) AS mean, CASE WHEN count(rev_) > 1 THEN sqrt(greatest("
    "(CAST(sum(CAST(CAST(rev_ AS DECIMAL(18,4)) AS DECIMAL(38,4)) * CAST(rev_ AS DECIMAL(18,4))) AS DOUBLE) - "
    "CAST(sum(CAST(rev_ AS DECIMAL(18,4))) AS DOUBLE) * CAST(sum(CAST(rev_ AS DECIMAL(18,4))) AS DOUBLE) "
    "/ count(rev_)) / (count(rev_) - 1), 0.0)) END AS std, "
    "min(total_revenue) AS min, max(total_revenue) AS max, q.q1, q.median, q.q3 FROM active_, "
    f"({spark_percentiles('active_', 'total_revenue', {'q1': 0.25, 'median': 0.5, 'q3': 0.75})}) q "
    "GROUP BY q.q1, q.median, q.q3"))
def q_describe_series(spark, sf_dir):
    return A.describe_series(S.active_period_calendar(_series(spark, sf_dir)))


@register("iqr_outliers", sql(
    "SELECT a.sale_date, a.total_revenue, q.q1, q.q3, q.q3 - q.q1 AS iqr, q.q1 - 1.5 * (q.q3 - q.q1) AS lower_fence, "
    "q.q3 + 1.5 * (q.q3 - q.q1) AS upper_fence, count(*) OVER () AS n_outliers, "
    "count(*) OVER () * 100.0 / q.n AS outlier_pct FROM active_ a, "
    f"({spark_percentiles('active_', 'total_revenue', {'q1': 0.25, 'q3': 0.75})}) q "
    "WHERE a.total_revenue > q.q3 + 1.5 * (q.q3 - q.q1)"))
def q_iqr_outliers(spark, sf_dir):
    return A.iqr_outliers(S.active_period_calendar(_series(spark, sf_dir)))


_WD = ("SELECT CAST(((dayofweek(sale_date) + 6) % 7) + 1 AS INTEGER) AS weekday_no, dayname(sale_date) AS weekday, total_revenue "
       "FROM active_")


@register("weekday_profile", sql(
    "SELECT s.weekday_no, s.weekday, CAST(q.n AS BIGINT) AS n_days, q.q1, q.median, q.q3, "
    "min(CASE WHEN s.total_revenue BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1) "
    "THEN s.total_revenue END) AS whisker_low, "
    "max(CASE WHEN s.total_revenue BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1) "
    "THEN s.total_revenue END) AS whisker_high, "
    "CAST(count(CASE WHEN NOT (s.total_revenue BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1)) "
    "THEN 1 END) AS BIGINT) AS n_outliers "
    f"FROM wd_ s JOIN ({spark_percentiles('wd_', 'total_revenue', {'q1': 0.25, 'median': 0.5, 'q3': 0.75}, 'weekday_no')}) q "
    "ON s.weekday_no = q.weekday_no GROUP BY s.weekday_no, s.weekday, q.n, q.q1, q.median, q.q3",
    extra_ctes=f"wd_ AS ({_WD})"))
def q_weekday_profile(spark, sf_dir):
    return A.weekday_profile(S.active_period_calendar(_series(spark, sf_dir)))


@register("zero_day_share", sql(
    "SELECT CAST(count(*) AS BIGINT) AS n_days, CAST(count(CASE WHEN total_revenue = 0 THEN 1 END) AS BIGINT) "
    "AS zero_days, count(CASE WHEN total_revenue = 0 THEN 1 END) * 100.0 / count(*) AS zero_pct FROM active_"))
def q_zero_day_share(spark, sf_dir):
    return A.zero_day_share(S.active_period_calendar(_series(spark, sf_dir)))


# ====================================================================== windows (W)
@register("rolling_7d", sql("SELECT sale_date, product_category, total_revenue, revenue_7d_rolling "
                            "FROM wide_sales_forecast"))
def q_rolling_7d(spark, sf_dir):
    return lake(spark, sf_dir).wide_sales_forecast.select("sale_date", "product_category", "total_revenue",
                                                          "revenue_7d_rolling")


@register("rolling_30d", sql("SELECT sale_date, product_category, total_revenue, revenue_30d_rolling "
                             "FROM wide_sales_forecast"))
def q_rolling_30d(spark, sf_dir):
    return lake(spark, sf_dir).wide_sales_forecast.select("sale_date", "product_category", "total_revenue",
                                                          "revenue_30d_rolling")


_RM = ("CAST(sum(rev_) OVER (ORDER BY sale_date ROWS BETWEEN {k} PRECEDING AND CURRENT ROW) AS DOUBLE) / "
       "count(*) OVER (ORDER BY sale_date ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)")


@register("rolling_mean_7_30", sql(
    f"SELECT sale_date, total_revenue AS daily_revenue, {_RM.format(k=6)} AS r7, {_RM.format(k=29)} AS r30 "
    "FROM positive_"))
def q_rolling_mean_7_30(spark, sf_dir):
    s = S.positive_days(_series(spark, sf_dir))
    return s.select("sale_date", F.col("total_revenue").alias("daily_revenue"),
                    S.rolling_mean(s, 7).alias("r7"), S.rolling_mean(s, 30).alias("r30"))


@register("rolling_mean_calendar", sql(
    f"SELECT sale_date, total_revenue, {_RM.format(k=29)} AS rolling_30 FROM active_"))
def q_rolling_mean_calendar(spark, sf_dir):
    s = S.active_period_calendar(_series(spark, sf_dir))
    return s.select("sale_date", "total_revenue", S.rolling_mean(s, 30).alias("rolling_30"))


# ====================================================================== top-k (L)
@register("top_customers", sql(
    f"SELECT dc.company_name, dc.country, dc.city, CAST(sum({rev('f.')}) AS DOUBLE) AS total_revenue, "
    "CAST(count(DISTINCT f.order_id) AS BIGINT) AS orders, "
    f"CAST(sum({rev('f.')}) AS DOUBLE) / NULLIF(count(DISTINCT f.order_id), 0) AS aov "
    "FROM fact_range_ f JOIN dim_customers dc ON f.customer_key = dc.customer_key "
    "GROUP BY dc.company_name, dc.country, dc.city "
    "ORDER BY total_revenue DESC NULLS LAST, company_name, country, city LIMIT 10"))
def q_top_customers(spark, sf_dir):
    lk = lake(spark, sf_dir)
    return L.top_customers(lk.fact_lines, lk.dim_customers, lk.dim_date, *_range(lk))


_PR = (f"SELECT dp.product_name, CAST(sum({rev('f.')}) AS DOUBLE) AS revenue FROM fact_range_ f "
       "JOIN dim_products dp ON f.product_key = dp.product_key GROUP BY dp.product_name ")


@register("top_products", sql(_PR + "ORDER BY revenue DESC NULLS LAST, product_name LIMIT 10"))
def q_top_products(spark, sf_dir):
    lk = lake(spark, sf_dir)
    return L.top_products(lk.fact_lines, lk.dim_products, lk.dim_date, *_range(lk))


@register("bottom_products", sql(_PR + "ORDER BY revenue ASC NULLS LAST, product_name LIMIT 10"))
def q_bottom_products(spark, sf_dir):
    lk = lake(spark, sf_dir)
    return L.bottom_products(lk.fact_lines, lk.dim_products, lk.dim_date, *_range(lk))


@register("recent_rows", sql("SELECT * FROM wide_sales_forecast ORDER BY sale_date DESC, product_category LIMIT 20"))
def q_recent_rows(spark, sf_dir):
    return L.recent_rows(lake(spark, sf_dir).wide_sales_forecast)


@register("tail_n", sql("SELECT sale_date, total_revenue FROM positive_ ORDER BY sale_date DESC LIMIT 30"))
def q_tail_n(spark, sf_dir):
    return _pub(L.tail_n(S.positive_days(_series(spark, sf_dir)), 30))


# ====================================================================== questions (B)
@register("top5_products_last_month", sql(
    f"SELECT CAST(date_trunc('month', b.mx) - INTERVAL 1 MONTH AS DATE) AS month, dp.product_name, "
    f"CAST(sum({rev('f.')}) AS DOUBLE) AS revenue, CAST(sum(f.quantity) AS BIGINT) AS quantity "
    "FROM fact_sales f JOIN dim_date dd ON f.date_key = dd.date_key "
    "JOIN dim_products dp ON f.product_key = dp.product_key, bounds_ b "
    "WHERE dd.full_date >= CAST(date_trunc('month', b.mx) - INTERVAL 1 MONTH AS DATE) "
    "AND dd.full_date < CAST(date_trunc('month', b.mx) AS DATE) "
    "GROUP BY 1, 2 ORDER BY revenue DESC NULLS LAST, product_name LIMIT 5"))
def q_top5_products_last_month(spark, sf_dir):
    lk = lake(spark, sf_dir)
    return B.top5_products_last_month(lk.fact_sales, lk.dim_products, lk.dim_date, lk.positive_bounds)


@register("monthly_revenue_latest_year", sql(
    "SELECT year, CAST(month(sale_date) AS INTEGER) AS month, CAST(sum(rev_) AS DOUBLE) AS revenue "
    "FROM wide_sales_forecast_ WHERE year = (SELECT max(year) FROM wide_sales_forecast_ WHERE total_revenue > 0) "
    "GROUP BY 1, 2"))
def q_monthly_revenue_latest_year(spark, sf_dir):
    return B.monthly_revenue_latest_year(lake(spark, sf_dir).wide_exact)


@register("best_aov_customer", sql(
    f"SELECT dc.customer_id, dc.company_name, CAST(sum({rev('f.')}) AS DOUBLE) AS total_revenue, "
    "CAST(count(DISTINCT f.order_id) AS BIGINT) AS orders, "
    f"CAST(sum({rev('f.')}) AS DOUBLE) / count(DISTINCT f.order_id) AS aov "
    "FROM fact_sales f JOIN dim_customers dc ON f.customer_key = dc.customer_key "
    "GROUP BY dc.customer_id, dc.company_name ORDER BY aov DESC NULLS LAST, customer_id LIMIT 1"))
def q_best_aov_customer(spark, sf_dir):
    lk = lake(spark, sf_dir)
    return B.best_aov_customer(lk.fact_sales, lk.dim_customers)


@register("category_growth_mom", sql(
    "SELECT product_category, month, CAST(m AS DOUBLE) AS revenue, "
    "CASE WHEN ok THEN CAST(p AS DOUBLE) END AS prev_revenue, "
    "CASE WHEN ok THEN CAST(m - p AS DOUBLE) END AS growth_abs, "
    "CASE WHEN ok AND p <> 0 THEN CAST(m - p AS DOUBLE) * 100 / CAST(p AS DOUBLE) END AS growth_pct "
    "FROM (SELECT product_category, month, m, lag(m) OVER (PARTITION BY product_category ORDER BY month) AS p, "
    "coalesce(lag(month) OVER (PARTITION BY product_category ORDER BY month) = "
    "CAST(month - INTERVAL 1 MONTH AS DATE), false) AS ok "
    "FROM (SELECT product_category, CAST(date_trunc('month', sale_date) AS DATE) AS month, sum(rev_) AS m "
    "FROM wide_sales_forecast_ GROUP BY 1, 2) t) u, bounds_ b "
    "WHERE u.month = CAST(date_trunc('month', b.mx) AS DATE)"))
def q_category_growth_mom(spark, sf_dir):
    lk = lake(spark, sf_dir)
    return B.category_growth_mom(lk.wide_exact, lk.positive_bounds)


@register("trend_last_30d", sql(
    "SELECT mx AS ref_date, CAST(n AS DOUBLE) AS revenue_30d, CAST(p AS DOUBLE) AS revenue_prev_30d, "
    "CAST(n - p AS DOUBLE) AS change_abs, CASE WHEN p <> 0 THEN CAST(n - p AS DOUBLE) * 100 / CAST(p AS DOUBLE) END "
    "AS change_pct, CASE WHEN n > p THEN 'increasing' WHEN n < p THEN 'decreasing' ELSE 'flat' END AS direction, "
    "CAST(n AS DOUBLE) / 30 AS avg_daily_30d, CAST(n AS DOUBLE) AS projected_next_30d "
    "FROM (SELECT b.mx, sum(CASE WHEN s.sale_date BETWEEN b.mx - INTERVAL 29 DAY AND b.mx THEN s.rev_ END) AS n, "
    "sum(CASE WHEN s.sale_date BETWEEN b.mx - INTERVAL 59 DAY AND b.mx - INTERVAL 30 DAY THEN s.rev_ END) AS p "
    "FROM series_ s, bounds_ b GROUP BY b.mx) t"))
def q_trend_last_30d(spark, sf_dir):
    lk = lake(spark, sf_dir)
    return B.trend_last_30d(lk.wide_exact, lk.positive_bounds)


# ====================================================================== incremental (I)

# --- scenario: the first run had loaded the lower half of the ids, less the orders
# placed from this day on; those arrive later, below the mark (late rows) ---
FIRST_RUN_BEFORE = "2000-01-01"
REDELIVERED_FROM = "1999-01-01"   # an overlapping re-delivery for the upsert
_T0 = ("t0_ AS (SELECT * FROM stg_orders WHERE order_id <= (SELECT (min(order_id) + max(order_id)) // 2 FROM stg_orders) "
       f"AND order_date < DATE '{FIRST_RUN_BEFORE}')")


def _first_run(orders):
    """The rows of an orders frame that the first run saw."""
    middle = orders.agg(F.expr("(min(order_id) + max(order_id)) div 2")).scalar()
    return orders.where((F.col("order_id") <= middle) & (F.col("order_date") < F.to_date(F.lit(FIRST_RUN_BEFORE))))


def _first_run_orders(lk):
    return _first_run(lk.stg_orders)


def _merge_sql(target: str, src: str, key: str) -> str:
    return (f"SELECT * FROM {target} t WHERE NOT EXISTS (SELECT 1 FROM {src} s WHERE s.{key} = t.{key}) "
            f"UNION ALL SELECT * FROM {src}")


@register("incr_stg_orders", sql(
    _merge_sql("t0_", "inc_", "order_id"),
    extra_ctes=_T0 + ", inc_ AS (SELECT * FROM stg_orders WHERE order_id > "
                     "(SELECT coalesce(max(order_id), 0) FROM t0_))"))
def q_incr_stg_orders(spark, sf_dir):
    lk = lake(spark, sf_dir)
    return I.incremental_model(lk.stg_orders, _first_run_orders(lk), "order_id", "order_id")


@register("incr_stg_order_details", sql(
    _merge_sql("t0d_", "incd_", "order_detail_id"),
    extra_ctes=_T0 + ", t0d_ AS (SELECT * FROM stg_order_details WHERE order_id IN (SELECT order_id FROM t0_)), "
                     "incd_ AS (SELECT * FROM stg_order_details WHERE order_id > "
                     "(SELECT coalesce(max(order_id), 0) FROM t0d_))"))
def q_incr_stg_order_details(spark, sf_dir):
    lk = lake(spark, sf_dir)
    target = lk.stg_order_details.join(_first_run_orders(lk).select("order_id"), "order_id", "left_semi")
    return I.incremental_model(lk.stg_order_details, target, "order_id", "order_detail_id", key_contains_id=True)


@register("incr_fact_sales", sql(
    _merge_sql("f0_", "incf_", "order_detail_id"),
    extra_ctes=_T0 + ", f0_ AS (SELECT * FROM fact_sales WHERE order_id IN (SELECT order_id FROM t0_)), "
                     "incf_ AS (SELECT * FROM fact_sales WHERE order_id > "
                     "(SELECT coalesce(max(order_id), 0) FROM f0_))"))
def q_incr_fact_sales(spark, sf_dir):
    lk = lake(spark, sf_dir)
    target = G.fact_sales(_first_run_orders(lk), lk.stg_order_details)
    mark = I.watermark_col(target, "order_id")
    # the mark filters the orders side; Catalyst infers it for the lines side too
    src = G.fact_sales(lk.stg_orders.where(F.col("order_id") > mark), lk.stg_order_details)
    return target.unionByName(src)          # the key is a hash that holds the order id: nothing can match


@register("merge_by_key", sql(
    _merge_sql("t0_", "src_", "order_id"),
    extra_ctes=_T0 + f", src_ AS (SELECT * FROM stg_orders WHERE order_date >= DATE '{REDELIVERED_FROM}')"))
def q_merge_by_key(spark, sf_dir):
    lk = lake(spark, sf_dir)
    src = lk.stg_orders.where(F.col("order_date") >= F.to_date(F.lit(REDELIVERED_FROM)))
    # MERGE contract: several source rows matching one target row is an error
    return I.merge_by_key(_first_run_orders(lk), src, "order_id")


@register("late_rows_dropped", sql(
    "SELECT * FROM stg_orders s WHERE s.order_id <= (SELECT coalesce(max(order_id), 0) FROM t0_) "
    "AND NOT EXISTS (SELECT 1 FROM t0_ t WHERE t.order_id = s.order_id)", extra_ctes=_T0))
def q_late_rows_dropped(spark, sf_dir):
    lk = lake(spark, sf_dir)
    return I.late_rows(lk.stg_orders, _first_run_orders(lk), "order_id", "order_id")


# ====================================================================== sources / sinks (S)


@register("bronze_overwrite", sql("SELECT * FROM b_orders"))
def q_bronze_overwrite(spark, sf_dir):
    lk, path = lake(spark, sf_dir), f"{C.fresh_root(spark)}/bronze/orders"
    C.load_full(lk.bronze["orders"], path)
    C.load_full(lk.bronze["orders"], path)       # a second full load replaces, not adds
    return spark.read.parquet(path)


@register("bronze_append", sql("SELECT * FROM b_orders UNION ALL SELECT * FROM b_orders"))
def q_bronze_append(spark, sf_dir):
    lk, path = lake(spark, sf_dir), f"{C.fresh_root(spark)}/bronze/orders"
    C.load_full(lk.bronze["orders"], path)
    C.load_append(lk.bronze["orders"], path)     # append keeps both copies
    return spark.read.parquet(path)


@register("align_to_schema", sql("SELECT * FROM b_order_details"))
def q_align_to_schema(spark, sf_dir):
    return C.align_to_schema(lake(spark, sf_dir).bronze["order_details"], BRONZE["order_details"])


@register("materialize_table", sql("SELECT * FROM dim_products"))
def q_materialize_table(spark, sf_dir):
    return C.materialize(lake(spark, sf_dir).dim_products, spark, "gold", "dim_products", C.fresh_root(spark))


_DECL = " UNION ALL ".join(f"SELECT 'bronze.{t}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows FROM b_{t}"
                           for t in BRONZE)


@register("declared_schemas", sql(_DECL))
def q_declared_schemas(spark, sf_dir):
    lk, root = lake(spark, sf_dir), C.fresh_root(spark)
    names = C.ensure_tables(spark, root)
    for t in BRONZE:                                   # typed tables accept the adapter's frames
        C.align_to_schema(lk.bronze[t], BRONZE[t]).write.insertInto(f"{C.namespace('bronze', root)}.{t}", overwrite=True)
    parts = [spark.table(n).agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(f"bronze.{n.split('.')[1]}").alias("table_name"), "n_rows") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("sample_rows")
def q_sample_rows(spark, sf_dir):
    return C.sample_rows(lake(spark, sf_dir).fact_sales, 10)


# ====================================================================== data quality (D)
@register("dq_unique", sql("SELECT order_detail_id, count(*) AS n_records FROM fact_sales "
                           "WHERE order_detail_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1"))
def q_dq_unique(spark, sf_dir):
    return Q.dq_unique(lake(spark, sf_dir).fact_sales, "order_detail_id")


@register("dq_not_null", sql("SELECT * FROM stg_orders WHERE employee_id IS NULL"))
def q_dq_not_null(spark, sf_dir):
    return Q.dq_not_null(lake(spark, sf_dir).stg_orders, "employee_id")


@register("dq_relationships", sql("SELECT f.employee_key AS from_field FROM fact_sales f WHERE f.employee_key IS NOT NULL "
                                  "AND NOT EXISTS (SELECT 1 FROM dim_employees d WHERE d.employee_key = f.employee_key "
                                  "AND d.country <> (SELECT min(country) FROM dim_employees))"))
def q_dq_relationships(spark, sf_dir):
    """Against parents that lack one country's employees, so that failures exist."""
    lk = lake(spark, sf_dir)
    return Q.dq_relationships(lk.fact_sales, "employee_key", _without_a_country(lk.dim_employees), "employee_key")


@register("dq_unique_combination", sql("SELECT order_id, product_key, count(*) AS n_records FROM fact_sales "
                                       "GROUP BY 1, 2 HAVING count(*) > 1"))
def q_dq_unique_combination(spark, sf_dir):
    fact = lake(spark, sf_dir).fact_lines
    if "product_key" in fact.columns:
        return Q.dq_unique_combination(fact, ["order_id", "product_key"])
    twice = Q.dq_unique_combination(fact, ["order_id", "product_id"])       # equal ids have equal keys, and are shorter
    return twice.select("order_id", K.fact_key(twice, "product_key"), "n_records")


@register("dq_expression", sql("SELECT * FROM wide_sales_forecast WHERE NOT coalesce(total_quantity < 50 AND "
                               "(SELECT max(sale_date) FROM wide_sales_forecast) >= DATE '1998-01-01', false)"))
def q_dq_expression(spark, sf_dir):
    """A row rule that some rows break, and the table-wide rule of the suite."""
    w = lake(spark, sf_dir).wide_sales_forecast
    return Q.dq_expression(w, (F.col("total_quantity") < 50)
                           & (w.agg(F.max("sale_date")).scalar() >= F.to_date(F.lit("1998-01-01"))))


def _models(lk):
    return {n: lk.model(n) for n in lk.SILVER + lk.GOLD}


@register("dq_suite", sql(oracle.suite_sql(Q.SILVER_TESTS + Q.GOLD_TESTS)))
def q_dq_suite(spark, sf_dir):
    return Q.run_suite(_models(lake(spark, sf_dir)), Q.SILVER_TESTS + Q.GOLD_TESTS)


_SUITE_FAILURES = "(SELECT sum(failures) FROM ({}) t)"
_LAYERED = oracle.PRELUDE.replace("l_discount AS discount\n  FROM lineitem", "l_discount AS discount\n  FROM lineitem QUALIFY "
                                  "row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_suppkey, l_linenumber, l_shipdate) = 1", 1) + f"""
SELECT stage, CASE WHEN bad THEN 'failed' WHEN skipped THEN 'skipped' ELSE 'ok' END AS status, CAST(n AS INTEGER) AS n_tables FROM (
  SELECT stage, n, i, bad, bool_or(bad) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS skipped
  FROM (VALUES (1, 'bronze', 7, false), (2, 'silver', 7, false), (3, 'silver_tests', 0, {_SUITE_FAILURES.format(oracle.suite_sql(Q.SILVER_TESTS))} > 0),
               (4, 'gold', 6, false), (5, 'gold_tests', 0, {_SUITE_FAILURES.format(oracle.suite_sql(Q.GOLD_TESTS))} > 0),
               (6, 'forecast', 1, false)) v(i, stage, n, bad))"""


@register("layered_run", _LAYERED)
def q_layered_run(spark, sf_dir):
    """All six stages, on lines that an order names once per product."""
    from mercato.plans.layers import forecast_stage, run_layers
    from mercato.sources.driver import bronze_from_driver, bronze_order_details
    bronze = dict(bronze_from_driver(spark, sf_dir).items())
    bronze["order_details"] = bronze_order_details(spark, sf_dir, distinct_products=True)
    log, tables = run_layers(spark, bronze, forecast=forecast_stage(spark))
    held = {"bronze": len(bronze), "silver": 7, "gold": 6, "forecast": int("forecast" in tables)}
    return spark.createDataFrame([(r.stage, r.status, held.get(r.stage, 0) if r.status == "ok" else 0) for r in log],
                                 "stage string, status string, n_tables int")


# ====================================================================== forecasting (F) and run records


def _training_series(spark, sf_dir):
    """The retrain input: the overall daily series, positive days only (P-05)."""
    return FC.prepare_series(S.active_period_positive(_series(spark, sf_dir)))


def _all_series(spark, sf_dir):
    """The series that are fitted: the overall one and one per category, positive days only."""
    wide = lake(spark, sf_dir).wide_exact.where((F.col("total_revenue") > 0) & F.col("product_category").isNotNull())
    per = FC.prepare_series(wide, F.concat(F.lit("category: "), F.col("product_category")))
    return _training_series(spark, sf_dir).unionByName(per)


def _trained(spark, sf_dir) -> dict:
    """Train once per application and data folder; artefacts are written as
    tables (coefficients, metrics, scores) and read back, like a stored model."""
    lk = lake(spark, sf_dir)             # one training per lake (raw or stored), kept with it
    if "trained" not in lk.__dict__:
        out = FC.train(spark, _all_series(spark, sf_dir))
        root = C.fresh_root(spark)
        stored = {}
        for name in ("scores", "metrics", "final", "split"):
            out[name].write.parquet(f"{root}/models/{name}")
            stored[name] = spark.read.parquet(f"{root}/models/{name}")
        stored["best"] = FC.best_params(stored["scores"])
        stored["root"] = root
        lk.__dict__["trained"] = stored
    return lk.__dict__["trained"]


@register("series_ds_y", sql("SELECT sale_date AS ds, total_revenue AS y FROM positive_"))
def q_series_ds_y(spark, sf_dir):
    return _training_series(spark, sf_dir).select("ds", "y")


@register("chrono_split", sql(
    "SELECT sale_date AS ds, total_revenue AS y, CASE WHEN row_number() OVER (ORDER BY sale_date) <= "
    "floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split FROM positive_"))
def q_chrono_split(spark, sf_dir):
    return FC.chrono_split(_training_series(spark, sf_dir)).select("ds", "y", "split")


_LIN = ("lin_ AS (SELECT sale_date, CAST(sum(rev_) OVER w30 AS DOUBLE) / count(*) OVER w30 AS r30, "
        "row_number() OVER (ORDER BY sale_date DESC) AS back_, count(*) OVER () AS n_ FROM positive_ "
        "WINDOW w30 AS (ORDER BY sale_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), "
        "lin_g_ AS (SELECT max(sale_date) AS last_date, arg_max(r30, sale_date) AS level, "
        "arg_min(r30, sale_date) AS first_r30, count(*) AS w_, max(n_) AS n_ FROM lin_ WHERE back_ <= 30), "
        "lin_p_ AS (SELECT last_date, level, (level - first_r30) / greatest(w_ - 1, 1) AS slope FROM lin_g_ "
        "WHERE n_ >= 7), "
        "lin_f_ AS (SELECT CAST(last_date + CAST(step AS INTEGER) AS DATE) AS ds, CAST(step AS INTEGER) AS step, "
        "level + slope * step AS yhat, (level + slope * step) * 0.85 AS yhat_lower, "
        "(level + slope * step) * 1.15 AS yhat_upper FROM lin_p_, range(1, 31) t(step))")


@register("forecast_linear", sql("SELECT * FROM lin_f_", extra_ctes=_LIN))
def q_forecast_linear(spark, sf_dir):
    return FC.linear_projection(S.positive_days(_series(spark, sf_dir)), 30)


@register("forecast_kpis", sql(
    "SELECT sum(yhat) AS forecast_total, avg(yhat) AS forecast_daily_mean, arg_max(ds, yhat) AS peak_date, "
    "max(yhat) AS peak_value FROM lin_f_", extra_ctes=_LIN))
def q_forecast_kpis(spark, sf_dir):
    return A.forecast_kpis(FC.linear_projection(S.positive_days(_series(spark, sf_dir)), 30))


@register("fit_additive")
def q_fit_additive(spark, sf_dir):
    s = _all_series(spark, sf_dir)
    defaults = s.select("series_key").distinct().select("series_key", F.lit(0.05).alias("cps"), F.lit(10.0).alias("sps"))
    return FC.fit_models(s, defaults, yearly=False)


@register("grid_search")
def q_grid_search(spark, sf_dir):
    return _trained(spark, sf_dir)["scores"]


@register("evaluate_best")
def q_evaluate_best(spark, sf_dir):
    return _trained(spark, sf_dir)["metrics"]


@register("forecast_error")
def q_forecast_error(spark, sf_dir):
    t = _trained(spark, sf_dir)
    pairs, _ = FC.evaluate_best(t["split"], t["best"], yearly=False)
    return A.forecast_error(pairs, keys=("series_key",))


@register("interval_coverage")
def q_interval_coverage(spark, sf_dir):
    """How often the test days of every series lie inside the forecast band."""
    t = _trained(spark, sf_dir)
    return FC.interval_coverage(t["split"], t["best"])


@register("fit_final")
def q_fit_final(spark, sf_dir):
    return _trained(spark, sf_dir)["final"]


@register("forecast_30")
def q_forecast_30(spark, sf_dir):
    t = _trained(spark, sf_dir)
    return FC.forecast(t["final"], t["split"].drop("split"), 30)


@register("future_only")
def q_future_only(spark, sf_dir):
    return FC.future_only(q_forecast_30(spark, sf_dir))


@register("day_forecast_table")
def q_day_forecast_table(spark, sf_dir):
    return FC.day_forecast_table(q_forecast_30(spark, sf_dir))


@register("forecast_vs_history")
def q_forecast_vs_history(spark, sf_dir):
    t = _trained(spark, sf_dir)
    return FC.forecast_vs_history(t["split"].drop("split"), q_forecast_30(spark, sf_dir))


@register("validation_forecast")
def q_validation_forecast(spark, sf_dir):
    """reload the stored coefficients and forecast 5 days past the history"""
    t = _trained(spark, sf_dir)
    model = spark.read.parquet(f"{t['root']}/models/final")
    return FC.future_only(FC.forecast(model, None, 5))


def _overall_record(t, stamp):
    """A run record is about the overall series."""
    overall = F.col("series_key") == "overall"
    return RUNS.run_record(t["metrics"].where(overall), t["final"].where(overall), stamp)


# --- scenario: twelve monthly runs of a forecast that repeats the week before; one stamp
# cannot be read, one file is not JSON, stamps come in three formats ---
_RUN_STAMPS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm")
_NAIVE = ("naive_ AS (SELECT sale_date, rev_ AS y, lag(rev_, 7) OVER (ORDER BY sale_date) AS yhat FROM active_), "
          "naive_error_ AS (SELECT date_trunc('month', sale_date) AS m, "
          "round(CAST(sum(abs(y - yhat)) AS DOUBLE) / count(*), 6) AS mae, "
          "round(sqrt(sum(CAST(y - yhat AS DOUBLE) * CAST(y - yhat AS DOUBLE)) / count(*)), 6) AS rmse, "
          "round(CAST(sum(y) AS DOUBLE) / count(*), 6) AS mean_test_revenue, count(*) AS n_test, max(sale_date) AS last_day "
          "FROM naive_ WHERE yhat IS NOT NULL GROUP BY 1), "
          "runs_ AS (SELECT *, row_number() OVER (ORDER BY m DESC) AS back_, mae <= 0.30 * mean_test_revenue AS meets_threshold, "
          "CAST(m + INTERVAL 1 MONTH + INTERVAL 2 HOUR AS TIMESTAMP) AS at_ FROM naive_error_), "
          "history_ AS (SELECT 'models/forecast_overall_' || strftime(at_, '%Y%m%d_%H%M%S') AS model_key, mae, rmse, mean_test_revenue, "
          "meets_threshold, strftime(last_day, '%Y-%m-%d') AS train_end_date, CASE WHEN back_ <> 3 THEN at_ END AS trained_at, "
          "'models/metrics_overall_' || strftime(at_, '%Y%m%d_%H%M%S') || '.json' AS _key FROM runs_ WHERE back_ <= 12)")


def _naive_pairs(spark, sf_dir):
    """Every active day with the revenue of the same weekday a week earlier as its forecast."""
    from pyspark.sql import Window
    s = S.active_period_calendar(_series(spark, sf_dir))
    return s.select("sale_date", F.col(S.EXACT).alias("y"), F.lag(S.EXACT, 7).over(Window.orderBy("sale_date")).alias("yhat")).where("yhat IS NOT NULL")


def _naive_errors(spark, sf_dir):
    e = A.forecast_error(_naive_pairs(spark, sf_dir).withColumn("m", F.trunc("sale_date", "month")).withColumns(
        {c: F.col(c).cast("double") for c in ("y", "yhat")}), keys=("m",))
    return e.select("m", "n_test", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "mean_test_revenue")], "meets_threshold")


@register("forecast_error_naive", oracle.sql("SELECT CAST(m AS DATE) AS m, n_test, mae, rmse, mean_test_revenue, meets_threshold FROM runs_", extra_ctes=_NAIVE))
def q_forecast_error_naive(spark, sf_dir):
    """A-14 on a forecast that both engines can make: the same weekday a week before."""
    return _naive_errors(spark, sf_dir)


def _history_root(spark, sf_dir) -> str:
    """The records of the scenario's runs, written as a trainer writes them, and one
    file that is not a record."""
    lk = lake(spark, sf_dir)
    if "history" not in lk.__dict__:
        root = C.fresh_root(spark)
        last = _naive_pairs(spark, sf_dir).groupBy(F.trunc("sale_date", "month").alias("m")).agg(F.max("sale_date").alias("last_day"))
        runs = _naive_errors(spark, sf_dir).join(last, "m").orderBy(F.desc("m")).limit(12).collect()      # twelve runs
        for back, r in enumerate(runs, 1):
            at = (r.m.replace(day=28) + _dt.timedelta(days=4)).replace(day=1)
            stamp, written = f"{at:%Y%m%d}_020000", (f"{at:%Y-%m-%d} 02:00:00", f"{at:%Y-%m-%d}T02:00:00", f"{at:%Y/%m/%d} 02:00")[back % 3]
            record = spark.createDataFrame([(f"models/forecast_overall_{stamp}", r.mae, r.rmse, r.mean_test_revenue, r.meets_threshold,
                                             f"{r.last_day:%Y-%m-%d}", "last night" if back == 3 else written)], RUN_RECORD)
            RUNS.write_run_record(record, root, stamp, indent=back % 2 == 0)
        spark.createDataFrame([("{not json",)], "value string").coalesce(1).write.text(f"{root}/models/metrics_overall_bad.json")
        lk.__dict__["history"] = root
    return lk.__dict__["history"]


@register("metrics_sink")
def q_metrics_sink(spark, sf_dir):
    t = _trained(spark, sf_dir)
    root, stamp = C.fresh_root(spark), _dt.datetime.now().strftime("%Y%m%d_%H%M%S")
    path = RUNS.write_run_record(_overall_record(t, stamp), root, stamp)
    return spark.read.schema("model_key string, mae double, rmse double, mean_test_revenue double, "
                             "meets_threshold boolean, train_end_date string, trained_at string").json(path)


@register("training_history", oracle.sql("SELECT * FROM history_", extra_ctes=_NAIVE))
def q_training_history(spark, sf_dir):
    """Every record but the unreadable file; file sizes are left to the tests."""
    return RUNS.training_history(spark, _history_root(spark, sf_dir)).drop("_size")


@register("latest_model", oracle.sql(
    "SELECT model_key, trained_at, mae, rmse, replace(model_key, 'forecast_', 'metrics_') || '.json' AS metrics_key "
    "FROM history_ WHERE trained_at IS NOT NULL ORDER BY trained_at DESC LIMIT 1", extra_ctes=_NAIVE))
def q_latest_model(spark, sf_dir):
    return RUNS.latest_model(RUNS.training_history(spark, _history_root(spark, sf_dir)))


@register("run_kpis", oracle.sql("SELECT count(*) AS n_runs, arg_max(mae, trained_at) AS latest_mae, arg_max(rmse, trained_at) AS latest_rmse "
                                 "FROM history_", extra_ctes=_NAIVE))
def q_run_kpis(spark, sf_dir):
    return A.run_kpis(RUNS.training_history(spark, _history_root(spark, sf_dir)))


@register("latest_first_history", oracle.sql("SELECT trained_at, train_end_date, mae, rmse, mean_test_revenue, meets_threshold, model_key FROM history_",
                                             extra_ctes=_NAIVE))
def q_latest_first_history(spark, sf_dir):
    return L.latest_first_history(RUNS.training_history(spark, _history_root(spark, sf_dir)))


# ====================================================================== keys, generators, screening (X, R)


@register("surrogate_key", sql(
    f"SELECT order_id, product_id, order_detail_id, {oracle.sk('order_id', 'product_id')} AS detail_key, "
    "md5(order_detail_id) AS detail_key_from_text FROM stg_order_details"))
def q_surrogate_key(spark, sf_dir):
    d = lake(spark, sf_dir).stg_order_details
    return d.select("order_id", "product_id", "order_detail_id",
                    K.surrogate_key("order_id", "product_id").alias("detail_key"),
                    F.md5("order_detail_id").alias("detail_key_from_text"))


@register("date_spine", sql(
    "SELECT CAST(unnest(generate_series(CAST(min(order_date) AS TIMESTAMP), CAST(max(order_date) AS TIMESTAMP), "
    "INTERVAL 1 DAY)) AS DATE) AS date_day FROM stg_orders"))
def q_date_spine(spark, sf_dir):
    b = lake(spark, sf_dir).stg_orders.agg(F.min("order_date").alias("s"),
                                           F.date_add(F.max("order_date"), 1).alias("e"))
    return K.spine_from_bounds(b, "s", "e")


# the given texts as statements of every kind: %-coded by (conv_id + turn) mod 8
_AS_STATEMENT = ("CASE (conv_id + turn) % 8 WHEN 0 THEN text WHEN 1 THEN 'SELECT ' || replace(text, ';', ',')"
                 " WHEN 2 THEN chr(160) || 'select 1 -- ' || replace(replace(text, ';', ','), chr(10), ' ')"
                 " WHEN 3 THEN 'WITH t AS (SELECT 1) DROP TABLE ' || replace(text, ';', ',')"
                 " WHEN 4 THEN 'SELECT 1; ' || text WHEN 5 THEN chr(8195) || chr(160)"
                 " WHEN 6 THEN '```sql' || chr(10) || 'SELECT /* ' || replace(text, ';', ',') || ' */ 1;' || chr(10) || '```'"
                 " ELSE 'SELECTED ' || text END")


@register("screen_sql_log", sql(oracle.screening_sql(f"(SELECT conv_id, turn, role, {_AS_STATEMENT} AS text FROM conversations) s_",
                                                     "text", ["conv_id", "turn", "role"],
                                                     R.FORBIDDEN_KEYWORDS, R.FENCE, R.BLOCK_COMMENT,
                                                     R.LINE_COMMENT)))
def q_screen_sql_log(spark, sf_dir):
    from mercato.sources.driver import read_driver
    spaces = _AS_STATEMENT.replace("chr(160)", "'\u00a0'").replace("chr(8195)", "'\u2003'")
    conv = read_driver(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.expr(spaces).alias("text"))
    return R.screen(conv, "text").drop("text")


@register("top_customers_display", sql(
    "SELECT company_name, country, city, '$' || format('{:,.0f}', total_revenue) AS total_revenue_fmt, orders, "
    "'$' || format('{:,.2f}', aov) AS aov_fmt FROM (" + oracle.PRELUDE.split('WITH ', 1)[0] +
    f"SELECT dc.company_name, dc.country, dc.city, CAST(sum({rev('f.')}) AS DOUBLE) AS total_revenue, "
    "CAST(count(DISTINCT f.order_id) AS BIGINT) AS orders, "
    f"CAST(sum({rev('f.')}) AS DOUBLE) / NULLIF(count(DISTINCT f.order_id), 0) AS aov "
    "FROM fact_range_ f JOIN dim_customers dc ON f.customer_key = dc.customer_key "
    "GROUP BY dc.company_name, dc.country, dc.city "
    "ORDER BY total_revenue DESC NULLS LAST, company_name, country, city LIMIT 10) t"))
def q_top_customers_display(spark, sf_dir):
    """C-17: the top-customer table formatted for display ($1,234 / $1,234.56)."""
    t = q_top_customers(spark, sf_dir)
    return t.select("company_name", "country", "city",
                    F.concat(F.lit("$"), F.format_number("total_revenue", 0)).alias("total_revenue_fmt"), "orders",
                    F.concat(F.lit("$"), F.format_number("aov", 2)).alias("aov_fmt"))


@register("synthetic_orders", sql("SELECT * FROM new_orders_", oracle.synthetic_orders_ctes(X)))
def q_synthetic_orders(spark, sf_dir):
    b = lake(spark, sf_dir).bronze
    return X.synthetic_orders(b["orders"], b["customers"], b["employees"], **{k: v for k, v in X.DEFAULTS.items()
                                                                            if k != "max_lines"})


@register("synthetic_lines", sql("SELECT * FROM new_lines_", oracle.synthetic_lines_ctes(X)))
def q_synthetic_lines(spark, sf_dir):
    b = lake(spark, sf_dir).bronze
    o = q_synthetic_orders(spark, sf_dir)
    return X.synthetic_lines(o, b["products"], X.DEFAULTS["max_lines"], X.DEFAULTS["seed"])


# ====================================================================== streaming


@register("stream_incr_orders", oracle.sql(
    _merge_sql("t0_", "inc_", "order_id"),
    extra_ctes=_T0 + ", inc_ AS (SELECT * FROM stg_orders WHERE order_id > "
                     "(SELECT coalesce(max(order_id), 0) FROM t0_))"))
def q_stream_incr_orders(spark, sf_dir):
    """Two deliveries land as files — the first run's orders, then a full
    re-delivery — and two scheduled availableNow runs of one
    file stream merge them into a versioned silver table."""
    lk, root = lake(spark, sf_dir), C.fresh_root(spark)
    orders = lk.bronze["orders"]
    first = _first_run(orders)
    target = C.VersionedTable(spark, f"{root}/silver/stg_orders")
    run = dict(spark=spark, landing=f"{root}/landing", schema=BRONZE["orders"], target=target,
               checkpoint=f"{root}/_checkpoints/stg_orders", transform=lambda b: _stg_orders(b, audit=False),
               id_col="order_id", key="order_id")
    land(first, run["landing"])
    run_once(**run)                       # day 1: first load
    land(orders, run["landing"])
    run_once(**run)                       # day 2: only ids above the mark are merged
    return target.current()


@register("list_tables", oracle.sql(
    "SELECT 'gold' AS namespace, t.n AS table_name FROM (VALUES ('dim_customers'), ('dim_products'), ('dim_employees'), "
    "('dim_date')) t(n) WHERE (SELECT count(*) FROM dim_date) > 0"))
def q_list_tables(spark, sf_dir):
    """S-11: the catalog after the gold dimensions were materialised into it."""
    lk, root = lake(spark, sf_dir), C.fresh_root(spark)
    for name in ("dim_customers", "dim_products", "dim_employees", "dim_date"):
        C.materialize(lk.model(name), spark, "gold", name, root)
    return C.list_tables(spark, root, ["gold"])


@register("incremental_refresh", oracle.sql(
    "SELECT * FROM f1_ UNION ALL SELECT * FROM fn_",
    extra_ctes=_T0 + ", d1_ AS (SELECT * FROM stg_order_details WHERE order_id IN (SELECT order_id FROM t0_)), "
    "o2_ AS (SELECT * FROM t0_ UNION ALL SELECT * FROM stg_orders WHERE order_id > "
    "(SELECT coalesce(max(order_id), 0) FROM t0_)), "
    "d2_ AS (SELECT * FROM d1_ UNION ALL SELECT * FROM stg_order_details WHERE order_id > "
    "(SELECT coalesce(max(order_id), 0) FROM d1_)), "
    f"f1_ AS ({oracle.fact_select('t0_', 'd1_')}), "
    f"fa_ AS ({oracle.fact_select('o2_', 'd2_')}), "
    "fn_ AS (SELECT * FROM fa_ WHERE order_id > (SELECT coalesce(max(order_id), 0) FROM f1_))"))
def q_incremental_refresh(spark, sf_dir):
    """Two scheduled runs of a stored lake — the first delivery, then the full
    one — where the big models only append rows above their marks; the
    resulting fact."""
    from mercato.plans.refresh import RefreshedLake, first_delivery
    lk = lake(spark, sf_dir)
    rl = RefreshedLake(spark, f"{C.fresh_root(spark)}/lake")
    rl.run(first_delivery(lk.bronze, _first_run(lk.bronze["orders"])))
    rl.run(lk.bronze)
    return rl.current().fact_sales


# --- scenario: the second run brings new ids of one month beyond the stored calendar ---
SECOND_RUN_MONTH = ("2000-06-01", "2000-06-30")
_SECOND_RUN = (f"(order_id <= (SELECT (min(order_id) + max(order_id)) // 2 FROM stg_orders_all_) AND order_date < DATE '{FIRST_RUN_BEFORE}') "
               "OR (order_id > (SELECT (min(order_id) + max(order_id)) // 2 FROM stg_orders_all_) "
               f"AND order_date BETWEEN DATE '{SECOND_RUN_MONTH[0]}' AND DATE '{SECOND_RUN_MONTH[1]}')")


def _refreshed_twice(spark, sf_dir):
    """A stored lake after its first run and a second one that touched a month."""
    from mercato.plans.refresh import RefreshedLake, first_delivery
    lk = lake(spark, sf_dir)
    if "refreshed" not in lk.__dict__:
        orders = lk.bronze["orders"]
        first = _first_run(orders)
        middle = orders.agg(F.expr("(min(order_id) + max(order_id)) div 2")).scalar()
        late = orders.where((F.col("order_id") > middle) & F.col("order_date").between(*[F.to_date(F.lit(d)) for d in SECOND_RUN_MONTH]))
        rl = RefreshedLake(spark, f"{C.fresh_root(spark)}/lake")
        rl.run(first_delivery(lk.bronze, first))
        rl.run(first_delivery(lk.bronze, first.unionByName(late)))
        lk.__dict__["refreshed"] = rl.current()
    return lk.__dict__["refreshed"]


@register("incremental_daily_category_sales", oracle.sql_of_orders(_SECOND_RUN, (
    "SELECT sale_date, product_category, total_revenue, total_orders, total_quantity, avg_order_value FROM daily_category_sales")))
def q_incremental_daily_category_sales(spark, sf_dir):
    """A-01 kept up by the change: equal to the aggregate of the whole fact."""
    return _refreshed_twice(spark, sf_dir).daily_cat.drop("_rev")


@register("incremental_wide_sales_forecast", oracle.sql_of_orders(_SECOND_RUN, "SELECT * FROM wide_sales_forecast"))
def q_incremental_wide_sales_forecast(spark, sf_dir):
    """G-06 kept up by the change: touched days and the 29 after them were replaced."""
    return _refreshed_twice(spark, sf_dir).wide_sales_forecast
