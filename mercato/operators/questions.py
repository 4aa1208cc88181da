"""The sample business questions as parametrised queries (B-*).

"Now" is the data's reference date: the latest day with positive revenue
(the wide table's last date is the calendar end, where revenue is 0).  The
reference date is a one-row aggregate broadcast into the plan, not a value
pulled to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.money import exact_line_revenue
from mercato.operators.aggregates import date_bounds
from mercato.operators.series import EXACT, daily_series


def _ref(bounds: DataFrame) -> DataFrame:
    """`bounds`: the one-row output of `date_bounds` (columns mn, mx)."""
    return F.broadcast(bounds.select(F.col("mx").alias("ref_date")))  # one row


def reference_bounds(wide_exact: DataFrame) -> DataFrame:
    return date_bounds(wide_exact)


def top5_products_last_month(fact: DataFrame, dim_products: DataFrame, dim_date: DataFrame,
                             bounds: DataFrame, n: int = 5) -> DataFrame:
    """B-01: best sellers (revenue) in the calendar month before the reference month."""
    r = _ref(bounds).select(F.add_months(F.trunc("ref_date", "month"), -1).alias("m0"),
                                F.trunc("ref_date", "month").alias("m1"))
    days = (dim_date.select("date_key", "full_date").crossJoin(r)
            .where((F.col("full_date") >= F.col("m0")) & (F.col("full_date") < F.col("m1")))
            .select("date_key", F.col("m0").alias("month")))
    g = (fact.join(F.broadcast(days), "date_key")             # ≤ 31 calendar rows
         .join(dim_products.select("product_key", "product_name"), "product_key")
         .groupBy("month", "product_name")
         .agg(F.sum(exact_line_revenue()).cast("double").alias("revenue"),
              F.sum("quantity").cast("bigint").alias("quantity")))
    return g.orderBy(F.desc_nulls_last("revenue"), F.asc_nulls_last("product_name")).limit(n)


def monthly_revenue_latest_year(wide_exact: DataFrame) -> DataFrame:
    """B-02: revenue per month of the most recent year that has revenue."""
    yr = F.broadcast(wide_exact.where(F.col("total_revenue") > 0).agg(F.max("year").alias("_y")))
    return (wide_exact.join(yr, F.col("year") == F.col("_y"))
            .groupBy("year", F.month("sale_date").alias("month"))
            .agg(F.sum(EXACT).cast("double").alias("revenue")))


def best_aov_customer(fact: DataFrame, dim_customers: DataFrame, n: int = 1) -> DataFrame:
    """B-03: customer with the highest revenue per distinct order."""
    g = (fact.join(dim_customers.select("customer_key", "customer_id", "company_name"), "customer_key")
         .groupBy("customer_id", "company_name")
         .agg(F.sum(exact_line_revenue()).alias("_r"), F.countDistinct("order_id").alias("orders")))
    rev = F.col("_r").cast("double")
    return (g.select("customer_id", "company_name", rev.alias("total_revenue"),
                     F.col("orders").cast("bigint").alias("orders"), (rev / F.col("orders")).alias("aov"))
            .orderBy(F.desc_nulls_last("aov"), F.asc_nulls_last("customer_id")).limit(n))


def category_growth_mom(wide_exact: DataFrame, bounds: DataFrame) -> DataFrame:
    """B-04: per category, the reference month against the month before it —
    absolute and percent growth (NULL when the base is 0), strongest first."""
    m = (wide_exact.groupBy("product_category", F.trunc("sale_date", "month").alias("month"))
         .agg(F.sum(EXACT).alias("_m")))
    w = Window.partitionBy("product_category").orderBy("month")
    m = m.select("product_category", "month", F.col("_m"), F.lag("_m").over(w).alias("_p"),
                 F.lag("month").over(w).alias("_pm"))
    r = _ref(bounds).select(F.trunc("ref_date", "month").alias("_rm"))
    cur = m.join(r, F.col("month") == F.col("_rm"))
    rev, prev = F.col("_m").cast("double"), F.col("_p").cast("double")
    valid = F.col("_pm") == F.add_months(F.col("month"), -1)
    prev = F.when(valid, prev)
    return (cur.select("product_category", "month", rev.alias("revenue"), prev.alias("prev_revenue"),
                       F.when(valid, (F.col("_m") - F.col("_p")).cast("double")).alias("growth_abs"),
                       F.when(valid & (F.col("_p") != 0),
                              (F.col("_m") - F.col("_p")).cast("double") * 100 / prev).alias("growth_pct"))
            .orderBy(F.desc_nulls_last("growth_pct"), F.asc_nulls_last("product_category")))


def trend_last_30d(wide_exact: DataFrame, bounds: DataFrame) -> DataFrame:
    """B-05: last 30 days against the 30 before, direction, and a rough
    30-day projection (the last 30-day rolling total, i.e. the rolling daily
    mean × 30 — an estimate, not a model output)."""
    s = daily_series(wide_exact).crossJoin(_ref(bounds))
    in_now = F.col("sale_date").between(F.date_sub("ref_date", 29), F.col("ref_date"))
    in_prev = F.col("sale_date").between(F.date_sub("ref_date", 59), F.date_sub("ref_date", 30))
    g = s.groupBy("ref_date").agg(F.sum(F.when(in_now, F.col(EXACT))).alias("_n"),
                                 F.sum(F.when(in_prev, F.col(EXACT))).alias("_p"))
    now, prev = F.col("_n").cast("double"), F.col("_p").cast("double")
    diff = (F.col("_n") - F.col("_p")).cast("double")
    return g.select("ref_date", now.alias("revenue_30d"), prev.alias("revenue_prev_30d"),
                    diff.alias("change_abs"),
                    F.when(F.col("_p") != 0, diff * 100 / prev).alias("change_pct"),
                    F.when(F.col("_n") > F.col("_p"), "increasing").when(F.col("_n") < F.col("_p"), "decreasing")
                    .otherwise("flat").alias("direction"),
                    (now / 30).alias("avg_daily_30d"), now.alias("projected_next_30d"))
