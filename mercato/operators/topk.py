"""Sort / limit / top-k reports (L-*).

`orderBy(...).limit(n)` plans as TakeOrderedAndProject: each task keeps its
own top n and only n rows per task reach the final merge — no global sort.
Every ordering ends in a unique tie-break so results are deterministic, and
NULLs sort last in both directions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.keys import join_dim
from mercato.functions.money import exact_line_revenue
from mercato.operators.aggregates import fact_in_range


def top_customers(fact: DataFrame, dim_customers: DataFrame, dim_date: DataFrame, start, end,
                  n: int = 10) -> DataFrame:
    """L-01: top n customers by revenue with country, city, orders and AOV."""
    key = "customer_key" if "customer_key" in fact.columns else "customer_id"
    # lines are joined by order, so their sum per order moves none; a quarter of the rows travels on
    f = fact_in_range(fact, dim_date, start, end).groupBy("order_id", key).agg(F.sum(exact_line_revenue()).alias("_r"))
    g = (join_dim(f, dim_customers, "customer_key", "company_name", "country", "city")
         .groupBy("company_name", "country", "city")
         .agg(F.sum("_r").alias("_r"), F.countDistinct("order_id").alias("orders")))
    rev = F.col("_r").cast("double")
    return (g.select("company_name", "country", "city", rev.alias("total_revenue"),
                     F.col("orders").cast("bigint").alias("orders"),
                     (rev / F.nullif(F.col("orders"), F.lit(0))).alias("aov"))
            .orderBy(F.desc_nulls_last("total_revenue"), F.asc_nulls_last("company_name"),
                     F.asc_nulls_last("country"), F.asc_nulls_last("city"))
            .limit(n))


def _product_revenue(fact: DataFrame, dim_products: DataFrame, dim_date: DataFrame, start, end) -> DataFrame:
    f = fact_in_range(fact, dim_date, start, end)
    return (join_dim(f, dim_products, "product_key", "product_name")
            .groupBy("product_name").agg(F.sum(exact_line_revenue()).cast("double").alias("revenue")))


def top_products(fact, dim_products, dim_date, start, end, n: int = 10) -> DataFrame:
    """L-02: the n best products by revenue (grouped by name, as the dashboard does)."""
    return (_product_revenue(fact, dim_products, dim_date, start, end)
            .orderBy(F.desc_nulls_last("revenue"), F.asc_nulls_last("product_name")).limit(n))


def bottom_products(fact, dim_products, dim_date, start, end, n: int = 10) -> DataFrame:
    """L-02 verbatim: the dashboard's "Top 10" sorts ascending — the n worst."""
    return (_product_revenue(fact, dim_products, dim_date, start, end)
            .orderBy(F.asc_nulls_last("revenue"), F.asc_nulls_last("product_name")).limit(n))


def recent_rows(wide: DataFrame, n: int = 20) -> DataFrame:
    """L-03: newest n rows of the wide table (category breaks date ties)."""
    return wide.orderBy(F.desc_nulls_last("sale_date"), F.asc_nulls_last("product_category")).limit(n)


def tail_n(series: DataFrame, n: int = 30, keys: tuple[str, ...] = (), order: str = "sale_date") -> DataFrame:
    """L-04: last n rows of each ordered series."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return series.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")


def latest_first_history(history: DataFrame) -> DataFrame:
    """L-05: run history newest first, only the listed columns that exist."""
    keep = [c for c in ("trained_at", "train_end_date", "mae", "rmse", "mean_test_revenue",
                        "meets_threshold", "model_key") if c in history.columns]
    return history.select(*keep).orderBy(F.desc_nulls_last("trained_at"))
