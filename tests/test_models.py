"""Silver/gold semantics on hand-made bronze rows: NULL and padded text,
'' vs NULL region, NULL name parts, NULL and orphan keys, unparsable values,
a product without category, orders without lines; the wide table against a
brute-force pandas computation."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mercato.functions.keys import SURROGATE_NULL_TOKEN, date_spine, surrogate_key
from mercato.lake import Lake
from mercato.sources.schemas import BRONZE

D = dt.date


def _bronze(spark):
    def frame(name, rows):
        cols = [f.name for f in BRONZE[name].fields]
        full = [tuple(r.get(c) for c in cols) for r in rows]
        return spark.createDataFrame(full, BRONZE[name])

    return {
        "customers": frame("customers", [
            {"customer_id": "ALFKI", "company_name": "  Alfreds  ", "city": " Berlin", "region": None, "country": "Germany"},
            {"customer_id": "ANATR", "company_name": "Ana", "city": "Mexico", "region": "", "country": "Mexico"},
            {"customer_id": "BONAP", "company_name": "Bon", "city": "Paris", "region": " IDF ", "country": "France"},
        ]),
        "employees": frame("employees", [
            {"employee_id": 1, "first_name": " Nancy ", "last_name": "Davolio ", "country": "USA"},
            {"employee_id": 2, "first_name": None, "last_name": "Fuller", "country": "USA"},
        ]),
        "categories": frame("categories", [{"category_id": 1, "category_name": " Beverages ", "picture": b"\x00"},
                                           {"category_id": 2, "category_name": "Condiments"}]),
        "suppliers": frame("suppliers", [{"supplier_id": 1, "company_name": " Exotic ", "region": None}]),
        "products": frame("products", [
            {"product_id": 1, "product_name": "Chai", "supplier_id": 1, "category_id": 1, "unit_price": 18.0,
             "discontinued": 0},
            {"product_id": 2, "product_name": "Aniseed", "supplier_id": 9, "category_id": 2, "unit_price": 10.0,
             "discontinued": 1},
            {"product_id": 3, "product_name": "Orphan", "supplier_id": 1, "category_id": None, "unit_price": 5.0,
             "discontinued": 0},
        ]),
        "orders": frame("orders", [
            {"order_id": 10, "customer_id": "ALFKI", "employee_id": 1, "order_date": D(1997, 1, 1), "freight": 3.5},
            {"order_id": 11, "customer_id": "ANATR", "employee_id": 2, "order_date": D(1997, 1, 3), "freight": 1.0},
            {"order_id": 12, "customer_id": "ZZZZZ", "employee_id": None, "order_date": D(1997, 1, 3), "freight": 2.0},
            {"order_id": 13, "customer_id": "BONAP", "employee_id": 1, "order_date": D(1997, 1, 9), "freight": 0.0},
        ]),
        "order_details": frame("order_details", [
            {"order_id": 10, "product_id": 1, "unit_price": 18.0, "quantity": 2, "discount": 0.0},
            {"order_id": 10, "product_id": 2, "unit_price": 10.0, "quantity": 1, "discount": 0.1},
            {"order_id": 11, "product_id": 1, "unit_price": 18.0, "quantity": 5, "discount": 0.05},
            {"order_id": 12, "product_id": 3, "unit_price": 5.0, "quantity": 4, "discount": 0.0},
            {"order_id": 12, "product_id": 2, "unit_price": 1e12, "quantity": 1, "discount": 0.0},  # no DECIMAL(10,2)
        ]),
    }


@pytest.fixture(scope="module")
def lake(spark):
    return Lake(spark, _bronze(spark), spine=("1997-01-01", "1997-01-11"))


def test_trim_and_region_default(lake):
    rows = {r.customer_id: r for r in lake.stg_customers.collect()}
    assert rows["ALFKI"].company_name == "Alfreds" and rows["ALFKI"].city == "Berlin"
    assert rows["ALFKI"].region == "N/A"          # NULL → default
    assert rows["ANATR"].region == ""             # blank stays blank
    assert rows["BONAP"].region == "IDF"


def test_suppliers_keep_null_region(lake):
    assert lake.stg_suppliers.first().region is None


def test_full_name_null_propagation(lake):
    e = {r.employee_id: r for r in lake.stg_employees.collect()}
    assert e[1].full_name == "Nancy Davolio"
    assert e[2].full_name is None
    d = {r.employee_id: r for r in lake.dim_employees.collect()}
    assert d[2].full_name is None


def test_unparsable_price_becomes_null(lake):
    bad = lake.stg_order_details.where("order_id = 12 AND product_id = 2").first()
    assert bad.unit_price is None and bad.line_revenue is None
    assert bad.order_detail_id == "12-2"


def test_surrogate_key_null_token(spark):
    df = spark.createDataFrame([(None, 1)], "a long, b long")
    k = df.select(surrogate_key("a", "b").alias("k"), F.md5(F.lit(SURROGATE_NULL_TOKEN + "-1")).alias("e")).first()
    assert k.k == k.e


def test_dim_products_left_joins(lake):
    p = {r.product_id: r for r in lake.dim_products.collect()}
    assert p[1].category_name == "Beverages" and p[1].supplier_name == "Exotic"
    assert p[2].supplier_name is None and p[2].is_discontinued is True
    assert p[3].category_name is None


def test_dim_date_spine_end_exclusive(spark):
    s = date_spine(spark, "1996-01-01", "1999-01-01")
    assert s.count() == 1096
    dd = Lake(spark, {}, spine=("1996-01-01", "1999-01-01")).dim_date
    r = dd.where("full_date = DATE'1996-01-06'").first()          # a Saturday
    assert r.date_key == 19960106 and r.is_weekend and r.quarter == 1


def test_fact_is_inner_join_with_keys(lake):
    f = lake.fact_sales.collect()
    assert len(f) == 5                               # order 13 has no line
    r = [x for x in f if x.order_id == 10 and x.quantity == 1][0]
    assert r.line_revenue == pytest.approx(9.0)
    assert r.date_key == 19970101
    nulls = [x for x in f if x.order_id == 12]
    # NULL employee hashes to the token key, which matches no dim row
    from mercato.operators.quality import dq_relationships
    orphans = dq_relationships(lake.fact_sales, "employee_key", lake.dim_employees, "employee_key").count()
    assert orphans == 2 and len(nulls) == 2


def test_wide_table_brute_force(lake):
    w = lake.wide_sales_forecast.toPandas()
    assert len(w) == 10 * 2                          # 10 days × 2 non-null categories (Orphan excluded)
    assert set(w.product_category) == {"Beverages", "Condiments"}
    # brute force from the fact rows
    f = lake.fact_sales.toPandas()
    p = lake.dim_products.toPandas()[["product_key", "category_name"]]
    f = f.merge(p, on="product_key")
    f["day"] = pd.to_datetime(f.date_key.astype(str))
    days = pd.date_range("1997-01-01", "1997-01-10")
    for cat in ("Beverages", "Condiments"):
        g = f[f.category_name == cat]
        daily = g.groupby("day").line_revenue.sum().reindex(days, fill_value=0.0)
        orders = g.groupby("day").order_id.nunique().reindex(days, fill_value=0)
        got = w[w.product_category == cat].sort_values("sale_date")
        assert list(got.total_revenue.round(6)) == list(daily.round(6))
        assert list(got.total_orders) == list(orders)
        assert list(got.revenue_7d_rolling.round(6)) == list(daily.rolling(7, min_periods=1).sum().round(6))
        assert list(got.revenue_30d_rolling.round(6)) == list(daily.rolling(30, min_periods=1).sum().round(6))
        aov = got[got.total_orders > 0]
        assert all(abs(aov.avg_order_value - aov.total_revenue / aov.total_orders) < 1e-9)
