"""Incremental loads: first run loads all, a rerun adds nothing, late rows
are reported, upserts replace matched rows, ambiguous merges fail, versioned
commits never touch the version being read."""

import pytest
from pyspark.sql import functions as F

from mercato.operators import incremental as I
from mercato.sources.catalog import VersionedTable, fresh_root


@pytest.fixture(scope="module")
def src(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (5, "e")], "id long, v string")


def test_first_run_loads_everything(src):
    assert I.incremental_model(src, None, "id", "id").count() == 4


def test_rerun_is_idempotent(spark, src):
    t1 = I.incremental_model(src, None, "id", "id")
    t2 = I.incremental_model(src, t1, "id", "id")
    assert sorted(r.id for r in t2.collect()) == [1, 2, 3, 5]
    assert I.watermark(t2, "id") == 5


def test_late_rows_are_not_loaded_but_reported(spark, src):
    target = src.where("id IN (1, 2, 5)")
    late_and_new = spark.createDataFrame([(3, "c"), (4, "d"), (6, "f")], "id long, v string")
    merged = I.incremental_model(late_and_new, target, "id", "id")
    assert sorted(r.id for r in merged.collect()) == [1, 2, 5, 6]             # 3 and 4 are below the mark
    assert sorted(r.id for r in I.late_rows(late_and_new, target, "id", "id").collect()) == [3, 4]


def test_merge_replaces_matched_and_inserts_new(spark, src):
    upd = spark.createDataFrame([(2, "B"), (7, "g")], "id long, v string")
    out = {r.id: r.v for r in I.merge_by_key(src, upd, "id").collect()}
    assert out == {1: "a", 2: "B", 3: "c", 5: "e", 7: "g"}


def test_ambiguous_merge_fails(spark, src):
    upd = spark.createDataFrame([(2, "x"), (2, "y")], "id long, v string")
    with pytest.raises(Exception, match="several source rows match the target row 2"):
        I.merge_by_key(src, upd, "id").collect()
    twice_new = spark.createDataFrame([(8, "x"), (8, "y")], "id long, v string")
    assert I.merge_by_key(src, twice_new, "id").count() == src.count() + 2


def test_scenarios_have_increments_and_late_rows(spark, sf_small):
    """The registered scenarios load something: a merge that returns its target is caught."""
    from mercato import query_defs as Q
    from mercato.queries import QUERIES, lake
    lk = lake(spark, sf_small)
    first, n = Q._first_run_orders(lk).count(), lk.stg_orders.count()
    mark = Q._first_run_orders(lk).agg(F.max("order_id")).first()[0]
    new = lk.stg_orders.where(F.col("order_id") > mark).count()
    assert 0 < first < n and new > 0
    assert QUERIES["incr_stg_orders"](spark, sf_small).count() == first + new
    assert QUERIES["stream_incr_orders"](spark, sf_small).count() == first + new
    assert 0 < QUERIES["late_rows_dropped"](spark, sf_small).count() == n - first - new
    lines = lk.fact_sales.join(Q._first_run_orders(lk).select("order_id"), "order_id", "left_semi").count()
    for name in ("incr_fact_sales", "incremental_refresh", "incr_stg_order_details"):
        assert QUERIES[name](spark, sf_small).count() > lines, name


def test_scalar_mark_matches_literal_mark(spark, src):
    t = src.where("id <= 2")
    lazy = I.incremental_source(src, t, "id")
    lit = I.incremental_source(src, t, "id", I.watermark(t, "id"))
    assert sorted(lazy.collect()) == sorted(lit.collect())


def test_literal_mark_is_pushed_to_the_scan(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(100).withColumnRenamed("id", "order_id").write.parquet(p)
    df = I.incremental_source(spark.read.parquet(p), spark.range(1).select(F.lit(40).alias("order_id")),
                              "order_id", 40)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(order_id,40)" in plan


def test_versioned_table(spark):
    t = VersionedTable(spark, fresh_root(spark) + "/vt")
    assert t.current() is None
    t.commit(spark.range(3))
    cur = t.current()
    t.commit(cur.union(spark.range(3, 5)))             # reads v1 while writing v2
    assert t.versions() == [1, 2] and t.current().count() == 5
    t.vacuum(keep=1)
    assert t.versions() == [2]


def test_model_with_its_id_as_key_is_not_shuffled(spark, src):
    target = src.where("id <= 2")
    plan = I.incremental_model(src, target, "id", "id", 2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert "Join" in I.incremental_model(src, target, "id", "v", 2)._jdf.queryExecution().executedPlan().toString()


def test_append_only_increment(spark, src):
    assert I.increment_is_append("id", "id") and not I.increment_is_append("id", "other")
    t = VersionedTable(spark, fresh_root(spark) + "/inc")
    t.append(src.where("id <= 2"))                        # creates v=1
    new = I.increment(src, t.current(), "id", I.watermark(t.current(), "id"))
    t.append(new)                                          # only ids 3 and 5 are written
    assert t.versions() == [1]
    assert sorted(r.id for r in t.current().collect()) == [1, 2, 3, 5]
    assert I.increment(src, t.current(), "id", I.watermark(t.current(), "id")).count() == 0


def test_refreshed_lake_appends_only_new_rows(spark, sf_small):
    from mercato.lake import Lake
    from mercato.plans.refresh import RefreshedLake
    bronze = Lake.from_driver(spark, sf_small).bronze
    # an earlier delivery that ends at the median order id, so the second run has new ids
    median = bronze["orders"].agg(F.percentile("order_id", 0.5)).first()[0]
    early = dict(bronze.items())
    early["orders"] = bronze["orders"].where(F.col("order_id") <= median)
    early["order_details"] = bronze["order_details"].where(F.col("order_id") <= median)
    rl = RefreshedLake(spark, fresh_root(spark) + "/lake")
    w1 = rl.run(early)
    n1 = rl.current().fact_sales.count()
    w2 = rl.run(bronze)
    w3 = rl.run(bronze)                                  # nothing new
    assert w1["first_run"] == 1 and w2["first_run"] == 0
    assert w2["stg_orders"] > 0 and rl.current().fact_sales.count() == n1 + w2["fact_sales"]
    assert (w3["stg_orders"], w3["stg_order_details"], w3["fact_sales"]) == (0, 0, 0)
    assert rl.tables["fact_sales"].versions() == [1]     # appended as deltas, never rewritten
    wide = rl.current().wide_sales_forecast
    assert wide.groupBy("sale_date", "product_category").count().where("count > 1").count() == 0
