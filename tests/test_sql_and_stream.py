"""SQL over the model views with screening; the streaming ingest end to end,
including a replay that must not change the target."""

import pytest
from pyspark.sql import functions as F

from mercato.lake import Lake
from mercato.operators import aggregates as A
from mercato.operators import screening as R
from mercato.plans.staging import stg_orders
from mercato.sources.catalog import VersionedTable, fresh_root
from mercato.sources.schemas import BRONZE
from mercato.streaming.incremental import land, run_once


def test_screened_sql_on_views(spark, sf_small):
    lk = Lake.from_driver(spark, sf_small)
    lk.create_views()
    text = ("```sql\n"
            "SELECT COUNT(DISTINCT fs.order_id) AS total_orders\n"
            "FROM fact_sales fs JOIN dim_date dd ON fs.date_key = dd.date_key\n"
            "WHERE dd.full_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' -- DROP later\n"
            "```;")
    got = R.run_if_safe(spark, text).first().total_orders
    exp = A.kpi_overview(lk.fact_sales, lk.dim_date, "1997-01-01", "1997-12-31").first().total_orders
    assert got == exp
    with pytest.raises(R.RejectedStatement) as e:
        R.run_if_safe(spark, "SELECT 1; DROP TABLE fact_sales")
    assert e.value.verdict == "multiple"


def test_stream_ingest_and_replay(spark, sf_small):
    lk = Lake.from_driver(spark, sf_small)
    orders = lk.bronze["orders"]
    root = fresh_root(spark)
    target = VersionedTable(spark, f"{root}/silver/stg_orders")
    run = dict(spark=spark, landing=f"{root}/landing", schema=BRONZE["orders"], target=target,
               checkpoint=f"{root}/_ckpt", transform=lambda b: stg_orders(b, audit=False),
               id_col="order_id", key="order_id")
    first = orders.where(F.col("order_date") < F.to_date(F.lit("2000-01-01")))
    land(first, run["landing"])
    run_once(**run)
    n1 = target.current().count()
    assert n1 == first.count()
    land(orders, run["landing"])                           # full re-delivery
    run_once(**run)
    mark = first.agg(F.max("order_id")).first()[0]
    expected = n1 + orders.where(F.col("order_id") > mark).count()
    assert target.current().count() == expected
    run_once(**run)                                        # nothing new: no change
    assert target.current().count() == expected
    assert target.current().groupBy("order_id").count().where("count > 1").count() == 0
