"""Declared bronze schemas (the typed landing tables).

Ids are LongType instead of the 16-bit integers a small OLTP seed uses: a
16-bit id overflows after 32,767 orders and then every append fails, and at
lakehouse scale order keys run into the trillions.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _DT, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.DateType(), T.BinaryType()


def _struct(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


BRONZE: dict[str, T.StructType] = {
    "categories": _struct(("category_id", _L), ("category_name", _S), ("description", _S), ("picture", _B)),
    "customers": _struct(("customer_id", _S), ("company_name", _S), ("contact_name", _S), ("contact_title", _S),
                         ("address", _S), ("city", _S), ("region", _S), ("postal_code", _S), ("country", _S),
                         ("phone", _S), ("fax", _S)),
    "employees": _struct(("employee_id", _L), ("last_name", _S), ("first_name", _S), ("title", _S),
                         ("title_of_courtesy", _S), ("birth_date", _DT), ("hire_date", _DT), ("address", _S),
                         ("city", _S), ("region", _S), ("postal_code", _S), ("country", _S), ("home_phone", _S),
                         ("extension", _S), ("photo", _B), ("notes", _S), ("reports_to", _L), ("photo_path", _S)),
    "orders": _struct(("order_id", _L), ("customer_id", _S), ("employee_id", _L), ("order_date", _DT),
                      ("required_date", _DT), ("shipped_date", _DT), ("ship_via", _I), ("freight", _D),
                      ("ship_name", _S), ("ship_address", _S), ("ship_city", _S), ("ship_region", _S),
                      ("ship_postal_code", _S), ("ship_country", _S)),
    "products": _struct(("product_id", _L), ("product_name", _S), ("supplier_id", _L), ("category_id", _L),
                        ("quantity_per_unit", _S), ("unit_price", _D), ("units_in_stock", _I),
                        ("units_on_order", _I), ("reorder_level", _I), ("discontinued", _I)),
    "order_details": _struct(("order_id", _L), ("product_id", _L), ("unit_price", _D), ("quantity", _I),
                             ("discount", _D)),
    "suppliers": _struct(("supplier_id", _L), ("company_name", _S), ("contact_name", _S), ("contact_title", _S),
                         ("address", _S), ("city", _S), ("region", _S), ("postal_code", _S), ("country", _S),
                         ("phone", _S), ("fax", _S), ("homepage", _S)),
}

# Layer namespaces
LAYERS = ("bronze", "silver", "gold")

# Record written by one forecasting run (seven fields).
RUN_RECORD = _struct(("model_key", _S), ("mae", _D), ("rmse", _D), ("mean_test_revenue", _D),
                     ("meets_threshold", T.BooleanType()), ("train_end_date", _S), ("trained_at", _S))
