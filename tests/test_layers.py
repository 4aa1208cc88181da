"""The layered run: stops at the first failing gate; runs to the forecast when told to continue."""

from pyspark.sql import functions as F

from mercato.functions.keys import surrogate_key
from mercato.lake import Lake
from mercato.operators import quality as Q
from mercato.plans import gold
from mercato.plans.layers import forecast_stage, run_layers
from mercato.sources import catalog
from mercato.sources.driver import bronze_from_driver


def test_stops_at_failing_gate_and_can_continue(spark, sf_small):
    log, tables = run_layers(spark, bronze_from_driver(spark, sf_small), forecast=forecast_stage(spark))
    st = {s.stage: s.status for s in log}
    assert st["bronze"] == st["silver"] == st["silver_tests"] == st["gold"] == "ok"
    # the driver data repeats (order, part) pairs: the unique line-key test must catch it
    assert st["gold_tests"] == "failed" and "order_detail_id" in [s for s in log if s.stage == "gold_tests"][0].detail
    assert st["forecast"] == "skipped"

    log, tables = run_layers(spark, bronze_from_driver(spark, sf_small), forecast=forecast_stage(spark),
                               stop_on_failure=False)
    st = {s.stage: s.status for s in log}
    assert st["forecast"] == "ok" and tables["forecast"].count() == 1


def test_restart_goes_on_after_the_last_finished_stage(spark, sf_small, monkeypatch):
    from mercato.plans import layers
    from mercato.sources import catalog
    from mercato.sources.driver import bronze_order_details
    bronze = dict(bronze_from_driver(spark, sf_small).items())
    bronze["order_details"] = bronze_order_details(spark, sf_small, distinct_products=True)
    root, written = catalog.fresh_root(spark), []
    put = catalog.materialize

    def counted(df, session, layer, name, where):
        if name == "dim_employees" and len(written) < 40:
            written.append("stopped")
            raise RuntimeError("lost")
        written.append(name)
        return put(df, session, layer, name, where)
    monkeypatch.setattr(catalog, "materialize", counted)
    import pytest
    with pytest.raises(RuntimeError):
        run_layers(spark, bronze, root)
    assert written.count("orders") == written.count("stg_orders") == 1
    written.extend([""] * 40)
    log, tables = run_layers(spark, bronze, root, forecast=lambda t: spark.createDataFrame([("overall", 1.0, True)], "series_key string, mae double, meets_threshold boolean"))
    assert [(r.stage, r.status) for r in log] == [(s, "ok") for s in layers.STAGES]
    assert written.count("orders") == written.count("stg_orders") == 1 and written.count("fact_sales") == 1
    n = len(written)
    again, same = run_layers(spark, bronze, root, forecast=lambda t: 1 / 0)
    assert [(r.stage, r.status) for r in again] == [(s, "ok") for s in layers.STAGES] and len(written) == n
    assert same["fact_sales"].count() == tables["fact_sales"].count() and same["forecast"].count() == 1


def test_one_line_per_product_moves_what_it_needs(spark, tmp_path, capsys):
    import datetime as dt

    from mercato.sources.driver import bronze_order_details, one_line_per_product

    day = [dt.datetime(2000, 1, d) for d in (1, 2, 3)]
    rows = [(1, 1, 5, 1, 1.0, 10.0, 0.1, 0.5, "A", day[0]), (1, 1, 4, 2, 2.0, 20.0, 0.2, 0.5, "B", day[1]), (1, 1, 4, 1, 3.0, 30.0, None, 0.5, "C", day[2]),
            (1, 1, 4, 1, 4.0, 40.0, 0.0, 0.5, "D", day[1]), (1, 2, None, 1, 5.0, 50.0, 0.3, 0.5, None, day[0]), (1, 2, 1, 1, 6.0, 60.0, 0.3, 0.5, "E", day[0]),
            (None, 1, 1, 1, 7.0, 70.0, 0.0, 0.5, "F", None), (None, 1, 1, 1, 8.0, 80.0, 0.0, 0.5, "G", day[0])]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                        "l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp")
    out = one_line_per_product(lines)
    assert out.columns == lines.columns
    assert sorted(r.l_quantity for r in out.collect()) == [4.0, 5.0, 7.0]
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    details = bronze_order_details(spark, str(tmp_path), distinct_products=True)
    assert sorted(r.quantity for r in details.collect()) == [4, 5, 7]
    details.explain()
    plan = capsys.readouterr().out
    assert "l_tax" not in plan and "l_returnflag" not in plan and "min_by" not in plan


def _lines(spark):
    rows = [(1, 1, "c1", 5), (1, 1, "c1", 5), (1, 2, "c9", None), (2, None, None, 5), (2, None, "_dbt_utils_surrogate_key_null_", 7), (None, 3, "c1", 6)]
    return spark.createDataFrame([(*r, 19970101, 2, 1.5, 0.1, 0.0) for r in rows],
                                 "order_id long, product_id long, customer_id string, employee_id long, date_key int, quantity int, "
                                 "unit_price double, discount double, freight double").withColumn("unit_price", F.col("unit_price").cast("decimal(10,2)"))


def test_a_fact_of_ids_fails_the_tests_its_keys_fail(spark):
    """Null ids, a text that stands for null, repeated lines and missing parents count the same either way."""
    lines, suite = _lines(spark), [t for t in Q.GOLD_TESTS if t.model == "fact_sales"]
    for null_parent in (False, True):
        models = {}
        for name, key, id_, ids in (("dim_customers", "customer_key", "customer_id", ["c1"]), ("dim_products", "product_key", "product_id", [1, 2]),
                                    ("dim_employees", "employee_key", "employee_id", [5, 5, 6])):
            kind = lines.schema[id_].dataType.simpleString()
            ids = spark.createDataFrame([(i,) for i in [*ids, *([None] if null_parent else [])]], f"{id_} {kind}")
            models[name] = ids.select(surrogate_key(id_).alias(key), id_)
        by_key = Q.run_suite(models | {"fact_sales": gold.with_keys(lines)}, suite)
        by_id = Q.run_suite(models | {"fact_sales": lines}, suite)
        rows = sorted(tuple(r) for r in by_key.collect())
        assert sorted(tuple(r) for r in by_id.collect()) == rows
        assert {(r[1], r[2]): r[3] for r in rows if r[1] == "relationships"} == {
            ("relationships", "customer_key"): 1 if null_parent else 3, ("relationships", "product_key"): 1 if null_parent else 3,
            ("relationships", "employee_key"): 1 if null_parent else 2}
        seen, tell = Q.observed(lines, suite[0])
        assert seen.count() == 6 and tell() == [("fact_sales", "not_null", "order_detail_id", 0)]


def test_the_fact_is_stored_without_hash_keys(spark, sf_small):
    """Keys of 32 characters a line were most of the run's disk; readers still get them."""
    bronze = bronze_from_driver(spark, sf_small)
    root = catalog.fresh_root(spark)
    for _ in range(2):                                     # the second run reads what the first one left
        log, tables = run_layers(spark, bronze, root, stop_on_failure=False)
        want = Lake(spark, bronze).fact_sales
        assert tables["fact_sales"].columns == want.columns and tables["fact_sales"].dtypes == want.dtypes
        assert tables["fact_sales"].exceptAll(want).isEmpty() and want.exceptAll(tables["fact_sales"]).isEmpty()
    files = spark.read.parquet(catalog.location(spark, "gold", "fact_sales", root))
    assert not {"order_detail_id", "customer_key", "product_key", "employee_key"} & set(files.columns)
    assert all(f.endswith(".zstd.parquet") for f in files.inputFiles())
