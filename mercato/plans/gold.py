"""Gold models: hash-keyed dimensions, the order-line fact and the gap-free
day × category table with rolling sums.

Plan notes (what Catalyst/AQE are expected to do at scale)
  * dims are projections of silver; `dim_products` left-joins two lookups
    whose size AQE checks at run time (broadcast below the threshold, sort-merge
    above it — no hint, because their size is not bounded by anything).
  * `fact_sales` is one equi-join on order_id (sort-merge at scale, AQE skew
    split for a hot order).
  * `dim_date` is bounded by the calendar range, so it is broadcast explicitly.
  * `wide_sales_forecast`: the fact is reduced to (day, category) before the
    spine join; the spine (days × categories) and the aggregate are both small;
    the two rolling sums share one exchange and one window stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.functions.keys import date_key, date_spine, fact_key, join_dim, spine_from_bounds, surrogate_key
from mercato.functions.money import exact_line_revenue, line_revenue

# --- fixed values: the default calendar of the date dimension ([start, end)) ---
DEFAULT_SPINE_START = "1996-01-01"
DEFAULT_SPINE_END = "1999-01-01"
# -------------------------------------------------------------------------------


def dim_customers(stg_customers: DataFrame) -> DataFrame:
    return stg_customers.select(surrogate_key("customer_id").alias("customer_key"), "customer_id",
                                "company_name", "city", "country", "region")


def dim_products(stg_products: DataFrame, stg_categories: DataFrame, stg_suppliers: DataFrame) -> DataFrame:
    p, c, s = stg_products.alias("p"), stg_categories.alias("c"), stg_suppliers.alias("s")
    return (p.join(c, F.col("p.category_id") == F.col("c.category_id"), "left")
            .join(s, F.col("p.supplier_id") == F.col("s.supplier_id"), "left")
            .select(surrogate_key(F.col("p.product_id")).alias("product_key"),
                    F.col("p.product_id").alias("product_id"),
                    F.col("p.product_name").alias("product_name"),
                    F.col("c.category_name").alias("category_name"),
                    F.col("s.company_name").alias("supplier_name"),
                    F.col("p.unit_price").alias("unit_price"),
                    F.col("p.is_discontinued").cast("boolean").alias("is_discontinued")))


def dim_employees(stg_employees: DataFrame) -> DataFrame:
    # recomputed from the parts; CONCAT is NULL when either part is NULL
    return stg_employees.select(surrogate_key("employee_id").alias("employee_key"), "employee_id",
                                F.concat("first_name", F.lit(" "), "last_name").alias("full_name"),
                                "title", "country", "reports_to")


def _date_attrs(spine: DataFrame, day: str = "date_day") -> DataFrame:
    d = F.col(day)
    return spine.select(date_key(d).alias("date_key"), d.cast("date").alias("full_date"),
                        F.dayofmonth(d).alias("day"), F.month(d).alias("month"),
                        F.quarter(d).alias("quarter"), F.year(d).alias("year"),
                        F.dayofweek(d).isin(1, 7).alias("is_weekend"))


def dim_date(spark: SparkSession, start=DEFAULT_SPINE_START, end=DEFAULT_SPINE_END) -> DataFrame:
    """Calendar [start, end) with smart key and attributes."""
    return _date_attrs(date_spine(spark, start, end))


def dim_date_for(orders: DataFrame, date_col: str = "order_date") -> DataFrame:
    """Calendar covering whole years of the data: Jan 1 of the first order's
    year up to (exclusive) Jan 1 after the last order's year."""
    bounds = orders.agg(F.trunc(F.min(date_col), "year").alias("s"),
                        F.add_months(F.trunc(F.max(date_col), "year"), 12).alias("e"))
    return _date_attrs(spine_from_bounds(bounds, "s", "e"))


def fact_lines(stg_orders: DataFrame, stg_order_details: DataFrame) -> DataFrame:
    """The fact's rows with the ids that its hash keys are made of."""
    o = stg_orders.select("order_id", "customer_id", "employee_id", date_key("order_date").alias("date_key"), "freight")
    od = stg_order_details.select("order_id", "product_id", "quantity", "unit_price", "discount")
    return o.join(od, "order_id").select("order_id", "product_id", "customer_id", "employee_id", "date_key",
                                         "quantity", "unit_price", "discount", "freight")


def with_keys(lines: DataFrame) -> DataFrame:
    """The fact: its lines with hash keys in place of the ids, and each line's revenue.
    Keys are long and do not compress, so what shuffles lines does it before this.
    Lines that have keys pass as they are."""
    if "order_detail_id" in lines.columns:
        return lines
    return lines.select("order_id", *[fact_key(lines, k) for k in ("order_detail_id", "customer_key", "product_key", "employee_key")],
                        "date_key", "quantity", "unit_price", "discount", line_revenue().alias("line_revenue"), "freight")


def fact_sales(stg_orders: DataFrame, stg_order_details: DataFrame) -> DataFrame:
    return with_keys(fact_lines(stg_orders, stg_order_details))


def daily_category_sales(fact: DataFrame, dim_date_df: DataFrame, dim_products_df: DataFrame,
                         keep_exact: bool = False) -> DataFrame:
    """Per (sale_date, category): revenue, distinct orders, quantity, AOV.

    Inner star join: a line whose date or product has no dim row is dropped.
    `fact` holds hash keys or, as `fact_lines`, ids.
    """
    d = F.broadcast(dim_date_df.select("date_key", "full_date"))  # bounded by the calendar
    g = (join_dim(fact.join(d, "date_key"), dim_products_df, "product_key", "category_name")
         .groupBy(F.col("full_date").cast("date").alias("sale_date"),
                  F.col("category_name").alias("product_category"))
         .agg(F.sum(exact_line_revenue()).alias("_rev"), F.countDistinct("order_id").alias("total_orders"),
              F.sum("quantity").cast("bigint").alias("total_quantity")))
    rev = F.col("_rev").cast("double")
    out = g.select("sale_date", "product_category", rev.alias("total_revenue"), "total_orders",
                   "total_quantity",
                   F.when(F.col("total_orders") == 0, F.lit(0.0))
                   .otherwise(rev / F.col("total_orders")).alias("avg_order_value"),
                   *(["_rev"] if keep_exact else []))
    return out


def wide_sales_forecast(fact: DataFrame, dim_date_df: DataFrame, dim_products_df: DataFrame,
                        keep_exact: bool = False, daily: DataFrame | None = None) -> DataFrame:
    """Gap-free day × category table with 7- and 30-row rolling revenue sums.

    `keep_exact` also returns `_rev`, the exact DECIMAL revenue behind
    `total_revenue`; readers that sum the table use it (see functions/money).
    `daily` is a stored `daily_category_sales` with `_rev`, built here when absent.
    """
    cats = (dim_products_df.where(F.col("category_name").isNotNull())
            .select(F.col("category_name").alias("product_category")).distinct())
    spine = (dim_date_df.select(F.col("full_date").alias("sale_date"), "year")
             .crossJoin(cats))
    daily = daily if daily is not None else daily_category_sales(fact, dim_date_df, dim_products_df, keep_exact=True)
    filled = (spine.join(daily, ["sale_date", "product_category"], "left")
              .select("sale_date", "year", "product_category",
                      F.coalesce("total_revenue", F.lit(0.0)).alias("total_revenue"),
                      F.coalesce("total_orders", F.lit(0)).cast("bigint").alias("total_orders"),
                      F.coalesce("total_quantity", F.lit(0)).cast("bigint").alias("total_quantity"),
                      F.coalesce("avg_order_value", F.lit(0.0)).alias("avg_order_value"),
                      F.coalesce("_rev", F.lit(0).cast("decimal(38,14)")).alias("_rev")))
    w = Window.partitionBy("product_category").orderBy("sale_date")
    return filled.select("sale_date", "year", "product_category", "total_revenue", "total_orders",
                         "total_quantity", "avg_order_value",
                         F.sum("_rev").over(w.rowsBetween(-6, 0)).cast("double").alias("revenue_7d_rolling"),
                         F.sum("_rev").over(w.rowsBetween(-29, 0)).cast("double").alias("revenue_30d_rolling"),
                         *(["_rev"] if keep_exact else []))
