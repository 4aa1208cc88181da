"""Driver contract: entry() runs; queries() and oracle_sql() line up."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "revenue_30d_rolling" in df.columns


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def test_stored_lake_answers_like_the_lazy_one(spark, sf_small):
    from mercato.lake import Lake
    from mercato.sources.catalog import fresh_root
    lazy = Lake.from_driver(spark, sf_small)
    stored = lazy.materialize(fresh_root(spark) + "/lake")
    for name in ("wide_sales_forecast", "fact_sales", "dim_products"):
        a, b = lazy.model(name), stored.model(name)
        assert a.columns == b.columns
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_partitioned_fact_gets_dynamic_partition_pruning(spark, sf_small):
    from mercato.lake import Lake
    from mercato.operators import aggregates as A
    from mercato.sources.catalog import fresh_root
    lazy = Lake.from_driver(spark, sf_small)
    stored = lazy.materialize(fresh_root(spark) + "/lake", fact_partition="date_key")
    start = stored.dim_date.agg({"full_date": "min"}).scalar()   # not a literal: pruning must be dynamic
    df = A.kpi_overview(stored.fact_sales, stored.dim_date, start, "1998-12-31")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    ref = A.kpi_overview(lazy.fact_sales, lazy.dim_date, start, "1998-12-31").first()
    assert df.first() == ref


def test_stored_orders_and_lines_join_without_an_exchange(spark, sf_small):
    from mercato.lake import Lake
    from mercato.plans import gold
    from mercato.sources.catalog import fresh_root
    stored = Lake.from_driver(spark, sf_small).materialize(fresh_root(spark) + "/lake", buckets=6)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = gold.fact_sales(stored.stg_orders, stored.stg_order_details)
        plan = fact._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2
        assert fact.exceptAll(stored.fact_sales).isEmpty() and fact.count() == stored.fact_sales.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    # every stored file of the fact holds a span of days of its own
    from pyspark.sql import functions as F
    spans = sorted((r.s, r.e) for r in stored.fact_sales.groupBy(F.input_file_name()).agg(F.min("date_key").alias("s"), F.max("date_key").alias("e")).collect())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
