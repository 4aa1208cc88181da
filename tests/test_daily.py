"""The day × category tables: a refresh equals a full rebuild and touches only its months."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mercato.lake import Lake
from mercato.plans import daily, gold
from mercato.plans.refresh import RefreshedLake
from mercato.sources.catalog import fresh_root


def same(a, b):
    assert a.columns == b.columns
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def rebuilt(rl):
    """Both tables, anew from the stored fact and dimensions."""
    lk = rl.current()
    day = gold.daily_category_sales(lk.fact_sales, lk.dim_date, lk.dim_products, keep_exact=True)
    return day, gold.wide_sales_forecast(lk.fact_sales, lk.dim_date, lk.dim_products, keep_exact=True)


def check(rl):
    day, wide = rebuilt(rl)
    lk = rl.current()
    assert same(lk.daily_cat.select(day.columns), day)
    assert same(lk.wide_exact.select(wide.columns), wide)


def files(df, but=()):
    return {f for f in df.inputFiles() if not any(f"sale_month={m}/" in f for m in but)}


@pytest.fixture(scope="module")
def bronze(spark, sf_small):
    """The small lake's bronze tables, with the orders of a year and a half."""
    b = dict(Lake.from_driver(spark, sf_small).bronze.items())
    b["orders"] = b["orders"].where("order_date between '1998-01-01' and '1999-06-30'")
    b["order_details"] = b["order_details"].join(b["orders"].select("order_id"), "order_id", "left_semi")
    return {n: df.coalesce(1).cache() for n, df in b.items()}


def delivered(bronze, condition, without_products=()):
    out = dict(bronze)
    out["orders"] = bronze["orders"].where(condition)
    out["order_details"] = bronze["order_details"].join(out["orders"].select("order_id"), "order_id", "left_semi")
    out["products"] = bronze["products"].where(~F.col("product_id").isin(*without_products, -1))
    return out


def test_runs_equal_a_rebuild_and_keep_other_months(spark, bronze):
    half = "order_id <= 750"
    rl = RefreshedLake(spark, fresh_root(spark) + "/lake")
    absent = [r.product_id for r in bronze["order_details"].where("order_id <= 750").select("product_id").distinct().orderBy("product_id").limit(2).collect()]
    w = rl.run(delivered(bronze, f"{half} and order_date < '1999-01-01'", absent))
    assert (w["daily"], w["wide"]) == ("built", "built")
    check(rl)
    assert rl.daily.orphans.current().count() > 0

    # a later delivery in one month of the stored calendar: 31 days and their halo at most
    may = "order_date between '1998-05-01' and '1998-05-31'"
    before = {n: files(rl.daily._stored(n), (199805, 199806)) for n in rl.daily.NAMES}
    w = rl.run(delivered(bronze, f"({half} and order_date < '1999-01-01') or (order_id > 750 and {may})", absent))
    assert 0 < w["daily"] <= 31 and w["daily"] < w["wide"] <= 31 + 29 and w["fact_sales"] > 0
    check(rl)
    assert before == {n: files(rl.daily._stored(n), (199805, 199806)) for n in rl.daily.NAMES}

    # nothing new: nothing is replaced
    seen = {n: files(rl.daily._stored(n)) for n in rl.daily.NAMES}
    w = rl.run(delivered(bronze, f"({half} and order_date < '1999-01-01') or (order_id > 750 and {may})", absent))
    assert (w["daily"], w["wide"], w["fact_sales"]) == (0, 0, 0)
    assert seen == {n: files(rl.daily._stored(n)) for n in rl.daily.NAMES}

    # the two products arrive: the days of their lines are touched, and no orphan is left
    days = rl.daily.orphans.current().select("date_key").distinct().count()
    w = rl.run(delivered(bronze, f"({half} and order_date < '1999-01-01') or (order_id > 750 and {may})"))
    assert w["daily"] == days and rl.daily.orphans.current().count() == 0
    check(rl)

    # the calendar grows by two years
    w = rl.run(delivered(bronze, f"({half} and order_date < '1999-01-01') or (order_id > 750 and (order_date < '1999-04-01'))"))
    check(rl)

    # a product moves to another category: everything is built anew
    moved = dict(bronze)
    moved["products"] = bronze["products"].withColumn("category_id", F.when(F.col("product_id") == absent[0], F.col("category_id") % 3 + 1).otherwise(F.col("category_id")))
    assert rl.run(moved)["daily"] == "built"
    check(rl)


def test_a_stopped_refresh_is_repeated(spark, bronze, monkeypatch):
    rl = RefreshedLake(spark, fresh_root(spark) + "/lake")
    rl.run(delivered(bronze, "order_id <= 750"))
    write = daily.DailyTables._write

    def stopped(self, name, df, mode):
        if name == "wide_exact":
            raise RuntimeError("stopped")
        write(self, name, df, mode)
    monkeypatch.setattr(daily.DailyTables, "_write", stopped)
    with pytest.raises(RuntimeError):
        rl.run(delivered(bronze, "order_id <= 760"))
    monkeypatch.setattr(daily.DailyTables, "_write", write)
    w = rl.run(delivered(bronze, "order_id <= 760"))
    assert w["fact_sales"] == 0 and w["daily"] > 0
    check(rl)


def test_a_day_reads_its_month_and_row_groups(spark, bronze):
    rl = RefreshedLake(spark, fresh_root(spark) + "/lake")
    rl.run(delivered(bronze, "order_id <= 300"))
    fact = rl.tables["fact_sales"]
    part = daily.days_of_fact(fact.current(raw=True), [19980510])
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_month" in plan and "(date_month" in plan and "GreaterThanOrEqual(date_key,19980510), LessThanOrEqual(date_key,19980510)" in plan
    assert fact.current().columns == rl.current().fact_sales.columns and "date_month" not in fact.current().columns


def test_spread():
    d = dt.date(2020, 3, 1)
    assert daily.spread([d], 0, 2) == {d, d + dt.timedelta(1), d + dt.timedelta(2)}
    assert daily.spread([d], 1, 0) == {d, dt.date(2020, 2, 29)}
