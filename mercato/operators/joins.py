"""Join operators (J-*).

Equi-joins are left to Catalyst/AQE: broadcast when a side is measured small
at run time, sort-merge otherwise, skewed partitions split by AQE.  Explicit
broadcast hints are used only for sides whose size is bounded by construction
(the calendar, one-row parameter frames).  Cross joins occur only between two
bounded frames (calendar × categories).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.keys import FACT_KEYS, fact_key, join_dim, without_dim
from mercato.functions.money import line_revenue


def join_orders_lines(stg_orders: DataFrame, stg_order_details: DataFrame) -> DataFrame:
    """J-01: inner equi-join on order_id (orders without lines drop out)."""
    o = stg_orders.select("order_id", "customer_id", "employee_id", "order_date")
    od = stg_order_details.select("order_id", "product_id", "quantity", "unit_price", "discount", "line_revenue")
    return o.join(od, "order_id", "inner")


def join_left_lookup(stg_products: DataFrame, stg_categories: DataFrame, stg_suppliers: DataFrame) -> DataFrame:
    """J-02: products with their category and supplier names (left outer: kept when missing)."""
    p = stg_products.select("product_id", "product_name", "category_id", "supplier_id")
    c = stg_categories.select("category_id", "category_name")
    s = stg_suppliers.select("supplier_id", F.col("company_name").alias("supplier_name"))
    return (p.join(c, "category_id", "left").join(s, "supplier_id", "left")
            .select("product_id", "product_name", "category_name", "supplier_name"))


def join_cross_spine(dim_date: DataFrame, dim_products: DataFrame) -> DataFrame:
    """J-03: every calendar day × every (non-null) category.  Both sides are
    bounded (days, categories); the product is the output size."""
    cats = (dim_products.where(F.col("category_name").isNotNull())
            .select(F.col("category_name").alias("product_category")).distinct())
    return dim_date.select(F.col("full_date").alias("sale_date"), "year").crossJoin(cats)


def join_spine_fill(spine: DataFrame, daily: DataFrame, keys=("sale_date", "product_category"),
                    fill: dict | None = None) -> DataFrame:
    """J-04: left outer join of the aggregate onto the spine, then zero fill."""
    fill = fill or {"total_revenue": 0.0, "total_orders": 0, "total_quantity": 0, "avg_order_value": 0.0}
    j = spine.join(daily, list(keys), "left")
    return j.select(*[F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in j.columns])


def star_join(fact: DataFrame, dim_date: DataFrame, dim_products: DataFrame, dim_customers: DataFrame) -> DataFrame:
    """J-05: fact ⋈ date ⋈ product ⋈ customer, inner (a missing key drops the line)."""
    f = fact.join(F.broadcast(dim_date.select("date_key", "full_date")), "date_key")
    f = join_dim(f, dim_customers, "customer_key", "company_name", "country")
    f = join_dim(f, dim_products, "product_key", "product_name", "category_name")
    return f.select("order_id", fact_key(fact, "order_detail_id"), "full_date", "product_name", "category_name",
                    "company_name", "country", "quantity", F.col("line_revenue") if "line_revenue" in fact.columns else line_revenue().alias("line_revenue"))


def anti_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str | None = None) -> DataFrame:
    """J-06: child rows whose (non-null) key has no parent row.

    Fact lines that carry ids have hash keys that are never null; they are compared by the ids."""
    parent_key = parent_key or child_key
    if child_key not in child.columns and child_key in FACT_KEYS:
        return without_dim(child, parent, child_key)
    keys = parent.select(F.col(parent_key).alias("_pk"))   # duplicates harmless for an anti join
    cond: Column = F.col(child_key) == F.col("_pk")
    return child.where(F.col(child_key).isNotNull()).join(keys, cond, "left_anti")
