"""Sources and sinks: schema alignment, overwrite/append, declared tables,
run records (malformed files skipped, bad stamps NULL, latest = last writer)."""

import pytest
from pyspark.sql import types as T

from mercato.sources import catalog as C
from mercato.sources import runs


def test_align_rejects_out_of_range(spark):
    schema = T.StructType([T.StructField("order_id", T.ShortType())])
    df = spark.createDataFrame([(40000,)], "order_id int")
    with pytest.raises(Exception):
        C.align_to_schema(df, schema).collect()
    ok = C.align_to_schema(spark.createDataFrame([(7,)], "order_id int"), schema)
    assert ok.schema == schema


def test_overwrite_and_append(spark):
    p = C.fresh_root(spark) + "/t"
    C.load_full(spark.range(3), p)
    C.load_full(spark.range(3), p)
    assert spark.read.parquet(p).count() == 3
    C.load_append(spark.range(3), p)
    assert spark.read.parquet(p).count() == 6


def test_declared_tables(spark):
    root = C.fresh_root(spark)
    names = C.ensure_tables(spark, root)
    assert len(names) == 7 and C.ensure_tables(spark, root) == names       # IF NOT EXISTS
    assert spark.table(f"{C.namespace('bronze', root)}.orders").schema.fieldNames()[0] == "order_id"
    assert {"bronze"} == {r.namespace for r in C.list_tables(spark, root).collect()}


def test_two_folders_keep_their_own_tables(spark):
    from mercato.queries import QUERIES
    frames = [QUERIES["declared_schemas"](spark, f"/root/testdata/{d}") for d in ("sf0.001", "sf0.01")]
    got = [{r.table_name: r.n_rows for r in f.collect()}["bronze.orders"] for f in frames]
    assert got == [1500, 15000]


def _record(spark, key, mae, at):
    return spark.createDataFrame([(key, mae, mae * 2, 100.0, True, "1998-05-06", at)], runs.RUN_RECORD)


def test_history_and_latest(spark):
    root = C.fresh_root(spark)
    runs.write_run_record(_record(spark, "models/forecast_overall_1", 10.0, "2024-01-02 02:00:00"), root, "1")
    runs.write_run_record(_record(spark, "models/forecast_overall_2", 50.0, "2024-01-03 02:00:00"), root, "2")
    runs.write_run_record(_record(spark, "models/forecast_overall_3", 1.0, "not a date"), root, "3")
    spark.createDataFrame([("{broken",)], "value string").write.text(f"{root}/models/metrics_overall_bad.json")
    h = runs.training_history(spark, root)
    rows = h.collect()
    assert len(rows) == 3 and rows[-1].trained_at is None                 # bad stamp → NULL, sorted last
    assert all(r._key.endswith(".json") or ".json/" in r._key for r in rows)
    latest = runs.latest_model(h).first()
    assert latest.model_key == "models/forecast_overall_2"                 # last writer, not best MAE
    assert latest.metrics_key == "models/metrics_overall_2.json"


def test_history_reads_indented_records(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "models").mkdir()
    (tmp_path / "models" / "metrics_overall_20240101_000000.json").write_text(
        '{\n  "model_key": "models/x",\n  "mae": 1.5,\n  "rmse": 2.0,\n  "mean_test_revenue": 9.0,\n'
        '  "meets_threshold": true,\n  "train_end_date": "1998-05-06",\n  "trained_at": "2024-01-01 00:00:00"\n}\n')
    rows = runs.training_history(spark, root, multiline=True).collect()
    assert len(rows) == 1 and rows[0].mae == 1.5


def test_jdbc_bounds_are_text():
    import datetime as dt

    from mercato.sources.jdbc import _bound
    assert _bound(7) == "7" and _bound(dt.date(2020, 1, 2)) == "2020-01-02"
    assert _bound(dt.datetime(2020, 1, 2, 3, 4, 5)) == "2020-01-02 03:04:05"


def test_materialize_swaps_the_location_under_a_running_reader(spark):
    from mercato.sources import catalog as C
    root = C.fresh_root(spark)
    first = C.materialize(spark.range(100), spark, "gold", "swapped", root)
    rows = first.toLocalIterator()                          # a reader that has begun
    assert next(rows).id >= 0
    old = C.location(spark, "gold", "swapped", root)
    now = C.materialize(spark.range(100, 105), spark, "gold", "swapped", root)
    assert sorted(r.id for r in now.collect()) == list(range(100, 105)) and C.location(spark, "gold", "swapped", root) != old
    assert len(list(rows)) == 99
    wide = C.materialize(spark.range(3).selectExpr("id", "id * 2 AS twice"), spark, "gold", "swapped", root)
    assert wide.columns == ["id", "twice"] and wide.count() == 3
    assert C.sweep(spark, "gold", "swapped", root) == 2 and spark.table(f"{C.namespace('gold', root)}.swapped").count() == 3
