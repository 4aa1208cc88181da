"""Silver models: typed, trimmed, defaulted projections of the bronze tables.

Casts are `try_cast`: under ANSI mode (Spark 4 default) a plain CAST of a bad
value aborts the whole job; a cleaning layer should yield NULL and let the
data-quality checks report the row.  Ids stay 64-bit (see sources/schemas).
Every model is a pure projection — narrow, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---
REGION_DEFAULT = "N/A"
# --------------------


def _tc(name: str, typ: str) -> Column:
    return F.col(name).try_cast(typ).alias(name)


def _trim(name: str, alias: str | None = None) -> Column:
    return F.trim(F.col(name)).alias(alias or name)


def _region(name: str) -> Column:
    # COALESCE(TRIM(x), 'N/A'): a blank string stays '' (only NULL is defaulted)
    return F.coalesce(F.trim(F.col(name)), F.lit(REGION_DEFAULT)).alias(name)


def _audit() -> Column:
    return F.current_timestamp().alias("_ingested_at")


def stg_customers(customers: DataFrame, audit: bool = True) -> DataFrame:
    cols = [F.col("customer_id").cast("string").alias("customer_id")]
    cols += [_trim(c) for c in ("company_name", "contact_name", "contact_title", "address", "city")]
    cols += [_region("region"), _trim("postal_code"), _trim("country"), _trim("phone")]
    return customers.select(*cols, *([_audit()] if audit else []))


def stg_orders(orders: DataFrame, audit: bool = True) -> DataFrame:
    cols = [_tc("order_id", "bigint"), F.col("customer_id").cast("string").alias("customer_id"),
            _tc("employee_id", "bigint"), _tc("order_date", "date"), _tc("required_date", "date"),
            _tc("shipped_date", "date"), _tc("ship_via", "int"), _tc("freight", "double"),
            _trim("ship_name"), _trim("ship_address"), _trim("ship_city"), _region("ship_region"),
            _trim("ship_postal_code"), _trim("ship_country")]
    return orders.select(*cols, *([_audit()] if audit else []))


def stg_order_details(order_details: DataFrame, audit: bool = True) -> DataFrame:
    price = F.col("unit_price").try_cast("decimal(10,2)")
    qty = F.col("quantity").try_cast("int")
    disc = F.col("discount").try_cast("double")
    cols = [_tc("order_id", "bigint"), _tc("product_id", "bigint"),
            price.alias("unit_price"), qty.alias("quantity"), disc.alias("discount"),
            # decimal × int × (1 − double) types as DOUBLE
            (price * qty * (F.lit(1) - disc)).alias("line_revenue"),
            # `||` semantics: NULL if either id is NULL (concat, not concat_ws)
            F.concat(F.col("order_id").try_cast("bigint").cast("string"), F.lit("-"),
                     F.col("product_id").try_cast("bigint").cast("string")).alias("order_detail_id")]
    return order_details.select(*cols, *([_audit()] if audit else []))


def stg_products(products: DataFrame) -> DataFrame:
    return products.select(_tc("product_id", "bigint"), _trim("product_name"), _tc("supplier_id", "bigint"),
                           _tc("category_id", "bigint"), F.col("unit_price").try_cast("decimal(10,2)").alias("unit_price"),
                           _tc("units_in_stock", "int"), _tc("units_on_order", "int"), _tc("reorder_level", "int"),
                           F.col("discontinued").try_cast("int").alias("is_discontinued"))


def stg_categories(categories: DataFrame) -> DataFrame:
    # the binary picture column is dropped here (column pruning keeps it out of the scan)
    return categories.select(_tc("category_id", "bigint"), _trim("category_name"), _trim("description"))


def stg_employees(employees: DataFrame, audit: bool = True) -> DataFrame:
    cols = [_tc("employee_id", "bigint"), _trim("first_name"), _trim("last_name"),
            F.concat(F.trim("first_name"), F.lit(" "), F.trim("last_name")).alias("full_name"),
            _trim("title"), _tc("birth_date", "date"), _tc("hire_date", "date"), _trim("city"),
            _region("region"), _trim("country"), _tc("reports_to", "bigint")]
    return employees.select(*cols, *([_audit()] if audit else []))


def stg_suppliers(suppliers: DataFrame) -> DataFrame:
    # trims only: no region default, no audit column
    return suppliers.select(_tc("supplier_id", "bigint"),
                            *[_trim(c) for c in ("company_name", "contact_name", "contact_title", "city",
                                                 "region", "postal_code", "country", "phone")])


MODELS = {
    "stg_customers": ("customers", stg_customers), "stg_orders": ("orders", stg_orders),
    "stg_order_details": ("order_details", stg_order_details), "stg_products": ("products", stg_products),
    "stg_categories": ("categories", stg_categories), "stg_employees": ("employees", stg_employees),
    "stg_suppliers": ("suppliers", stg_suppliers),
}
