"""Data-quality checks find planted faults; the suite reports one row per test."""

from pyspark.sql import functions as F

from mercato.lake import Lake
from mercato.operators import quality as Q


def test_planted_faults(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (None, "c", 2), (3, "d", 9)], "k long, v string, p long")
    parent = spark.createDataFrame([(1,), (2,)], "p long")
    assert [r.k for r in Q.dq_unique(df, "k").collect()] == [1]
    assert Q.dq_not_null(df, "k").count() == 1
    assert [r.from_field for r in Q.dq_relationships(df, "p", parent, "p").collect()] == [9]
    assert Q.dq_unique_combination(df, ["k", "p"]).count() == 1
    assert Q.dq_expression(df, F.col("p") < 5).count() == 1
    assert Q.dq_expression(df, F.lit(None).cast("boolean")).count() == 4     # NULL is not true


def test_null_child_keys_are_ignored(spark):
    df = spark.createDataFrame([(None,), (1,)], "p long")
    parent = spark.createDataFrame([(1,)], "p long")
    assert Q.dq_relationships(df, "p", parent, "p").count() == 0


def test_suite_shape_and_declared_counts(spark, sf_small):
    lk = Lake.from_driver(spark, sf_small)
    models = {n: lk.model(n) for n in lk.SILVER + lk.GOLD}
    res = {(r.model, r.test, r.column): r.failures for r in Q.run_suite(models, Q.SILVER_TESTS + Q.GOLD_TESTS).collect()}
    tests = [k[1] for k in res]
    assert tests.count("unique") == 11 and tests.count("not_null") == 17
    assert tests.count("relationships") == 3 and tests.count("unique_combination") == 1
    assert tests.count("expression") == 1
    assert res[("stg_orders", "unique", "order_id")] == 0
    assert res[("wide_sales_forecast", "unique_combination", "sale_date,product_category")] == 0
    assert res[("fact_sales", "relationships", "customer_key")] == 0


def test_fused_suite_equals_the_single_tests(spark):
    """Every count of the fused passes against the operator of its test."""
    child = spark.createDataFrame([(1, "a", 1, 5.0), (1, "b", None, 6.0), (None, "c", 2, None), (None, None, 9, 1.0), (4, "d", 9, 2.0)],
                                  "k long, v string, p long, x double")
    parent = spark.createDataFrame([(1,), (1,), (None,), (2,)], "p long")
    t = Q.ModelTests("child", unique=["k"], not_null=["k", "v", "x"], relationships=[("p", "parent", "p"), ("k", "parent", "p")],
                     unique_combination=[["k", "p"]], expressions=[("small", lambda m: F.col("x") < 6)])
    models = {"child": child, "parent": parent}
    want = {("unique", "k"): Q.dq_unique(child, "k").count(), ("unique_combination", "k,p"): Q.dq_unique_combination(child, ["k", "p"]).count(),
            ("expression", "small"): Q.dq_expression(child, F.col("x") < 6).count(),
            **{("not_null", c): Q.dq_not_null(child, c).count() for c in ("k", "v", "x")},
            **{("relationships", c): Q.dq_relationships(child, c, parent, "p").count() for c in ("p", "k")}}
    got = {(r.test, r.column): r.failures for r in Q.run_suite(models, [t]).collect()}
    assert got == want and min(want.values()) >= 0 and want[("relationships", "p")] == 2
    seen, tell = Q.observed(child, t)
    seen.write.format("noop").mode("overwrite").save()
    assert {(r[1], r[2]): r[3] for r in tell()} == {k: n for k, n in want.items() if k[0] == "not_null"}
    again = Q.run_suite(models, [t], known=tell())
    assert {(r.test, r.column): r.failures for r in again.collect()} == want and again.count() == len(want)


def test_fact_is_scanned_once_beside_its_unique_key(spark, sf_small):
    """Stored models: one scan for the unique key, one for nulls and the three relationships."""
    from mercato.sources.catalog import fresh_root
    path = fresh_root(spark) + "/fact"
    lk = Lake.from_driver(spark, sf_small)
    lk.fact_sales.write.parquet(path)
    models = {n: lk.model(n) for n in ("dim_customers", "dim_products", "dim_employees")} | {"fact_sales": spark.read.parquet(path)}
    tests = [t for t in Q.GOLD_TESTS if t.model == "fact_sales"]
    plan = Q.run_suite(models, tests)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("order_detail_id" in x or "customer_key" in x for x in plan.split("Relation [")[1:] if "line_revenue" in x) == 2
