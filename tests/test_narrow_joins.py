"""Lines travel with ids; hash keys are made where the result needs them."""

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mercato.functions.keys import surrogate_key
from mercato.operators import joins as J
from mercato.operators import topk as L
from mercato.plans import gold
from mercato.plans.daily import DailyTables
from mercato.sources.catalog import VersionedTable


@pytest.fixture(scope="module")
def star(spark):
    orders = spark.createDataFrame(
        [(1, "a", 7, dt.date(2000, 1, 1), 0.0), (2, None, 7, dt.date(2000, 1, 2), 0.0), (2, "a", None, dt.date(2000, 1, 2), 0.0),
         (None, "b", 8, dt.date(2000, 1, 3), 0.0), (3, "_dbt_utils_surrogate_key_null_", 8, None, 0.0), (4, "b", 8, dt.date(2000, 1, 4), 0.0)],
        "order_id long, customer_id string, employee_id long, order_date date, freight double")
    d = Decimal("2.50")
    details = spark.createDataFrame(
        [(1, 1, d, 2, 0.1), (1, None, d, 3, 0.0), (2, 0, d, 1, 0.0), (2, 1, None, 1, 0.0), (3, 1, d, 4, 0.0), (4, 2, d, 5, None),
         (4, 2, d, 5, 0.2), (None, 1, d, 1, 0.0)],
        "order_id long, product_id long, unit_price decimal(10,2), quantity int, discount double")
    products = spark.createDataFrame([(1, "p", "x"), (None, "n", "y"), (0, "z", None), (1, "twice", "x"), (2, "q", "y")],
                                     "product_id long, product_name string, category_name string")
    customers = spark.createDataFrame([("a", "A", "X", "s"), (None, "N", "X", "t"), ("b", "A", "X", "s")],
                                      "customer_id string, company_name string, country string, city string")
    return (gold.fact_lines(orders, details), gold.fact_sales(orders, details), gold.dim_date(spark, "2000-01-01", "2001-01-01"),
            products.withColumn("product_key", surrogate_key("product_id")),
            customers.withColumn("customer_key", surrogate_key("customer_id")))


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_ids_join_as_their_keys_do(star):
    lines, fact, days, products, customers = star
    for of in (lambda f: J.star_join(f, days, products, customers),
               lambda f: gold.daily_category_sales(f, days, products, keep_exact=True),
               lambda f: L.top_customers(f, customers, days, "2000-01-01", "2000-12-31"),
               lambda f: L.top_products(f, products, days, "2000-01-01", "2000-12-31")):
        assert _rows(of(lines)) == _rows(of(fact)) != []
    assert "Row(order_id=1, order_detail_id" in "".join(_rows(J.star_join(lines, days, products, customers)))


def test_no_hash_key_is_shuffled(spark, star, capsys):
    lines, _, days, products, customers = star
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (J.star_join(lines, days, products, customers), gold.daily_category_sales(lines, days, products),
                   L.top_customers(lines, customers, days, "2000-01-01", "2000-12-31")):
            df.explain()
            plan = capsys.readouterr().out
            moved = re.findall(r"hashpartitioning\((.*)", plan)
            assert moved and not [m for m in moved if re.search("(customer|product|employee)_key", m)]
            assert "md5(cast(customer_id" not in plan and "md5(cast(product_id" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_table_is_ranged_before_its_keys_are_made(spark, star, tmp_path):
    lines, fact, *_ = star
    t = VersionedTable(spark, str(tmp_path / "fact"), month_of="date_key", finish=gold.with_keys)
    t.commit(lines.where("order_id < 3"))
    assert t.append(lines.where("order_id >= 3")) == lines.where("order_id >= 3").count()
    assert t.append(lines.where("order_id > 9")) == 0
    assert t.current().columns == fact.columns and _rows(t.current()) == _rows(fact.where(F.col("order_id").isNotNull()))


def test_orphans_are_found_by_id_before_keys_are_made(spark, star, capsys):
    lines, fact, _, _, customers = star
    for parents in (customers, customers.where("customer_id = 'a'"), customers.where("customer_id is null"), customers.where("false"),
                    customers.unionAll(customers)):
        keyed = _rows(J.anti_orphans(fact, parents, "customer_key"))
        assert _rows(gold.with_keys(J.anti_orphans(lines, parents, "customer_key"))) == keyed
    assert len(_rows(J.anti_orphans(lines, customers.where("customer_id = 'a'"), "customer_key"))) > 2
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        gold.with_keys(J.anti_orphans(lines, customers, "customer_key")).explain()
        plan = capsys.readouterr().out
        assert "Exchange" in plan and not [m for m in re.findall(r"hashpartitioning\((.*)", plan) if "_key" in m.replace("_key_null_", "")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_table_stores_ids_and_makes_keys_when_read(spark, star, tmp_path):
    lines, fact, *_ = star
    t = VersionedTable(spark, str(tmp_path / "fact"), month_of="date_key", finish=gold.with_keys)
    t.commit(lines)
    assert set(t.current(raw=True).columns) == {*lines.columns, "date_month"}
    assert t.compact() == 2 and _rows(t.current()) == _rows(fact) != []
    with pytest.raises(ValueError):
        t.append(fact)


def test_days_without_a_product_are_found_by_its_id(spark, star, tmp_path):
    lines, fact, _, products, _ = star
    daily = DailyTables(spark, str(tmp_path))
    for known in (products, products.where("product_id = 1"), products.where("product_id is null"), products.where("false")):
        keyed = fact.join(known.select("product_key"), "product_key", "left_anti").select("product_key", "date_key").distinct()
        assert _rows(daily._without_product(lines, known)) == _rows(keyed)
    assert len(_rows(daily._without_product(lines, products.where("product_id = 1")))) > 2
