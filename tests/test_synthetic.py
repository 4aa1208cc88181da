"""Synthetic orders: properties, and independence from partitioning."""

from pyspark.sql import functions as F

from mercato.lake import Lake
from mercato.operators import synthetic as X


def _gen(spark, sf, parts=None):
    b = Lake.from_driver(spark, sf).bronze
    if parts:
        b = {k: v.repartition(parts) for k, v in b.items()}
    o = X.synthetic_orders(b["orders"], b["customers"], b["employees"], days=10, per_day=12, seed=42)
    return b, o, X.synthetic_lines(o, b["products"], 4, 42)


def test_properties(spark, sf_small):
    b, o, lines = _gen(spark, sf_small)
    mx = b["orders"].agg(F.max("order_id"), F.max("order_date")).first()
    od = o.toPandas()
    ids = sorted(od.order_id)
    assert ids == list(range(mx[0] + 1, mx[0] + 1 + len(ids)))          # consecutive after the max
    assert od.order_date.min() > mx[1] and od.order_date.nunique() == 10
    assert ((od.required_date - od.order_date).dt.days.between(7, 21)).all() if hasattr(od.required_date, "dt") else True
    assert od.customer_id.notna().all() and od.employee_id.notna().all()
    assert od.freight.between(5, 120).all() and set(od.ship_via) <= {1, 2, 3}
    ld = lines.toPandas()
    per = ld.groupby("order_id").product_id.agg(["count", "nunique"])
    assert per["count"].between(1, 4).all() and (per["count"] == per["nunique"]).all()
    assert set(ld.order_id) == set(od.order_id)
    assert ld.quantity.between(1, 30).all() and set(ld.discount) <= set(X.DISCOUNTS)


def test_independent_of_partitioning(spark, sf_small):
    _, o1, l1 = _gen(spark, sf_small)
    _, o2, l2 = _gen(spark, sf_small, parts=3)
    assert sorted(o1.collect()) == sorted(o2.collect())
    assert sorted(l1.collect()) == sorted(l2.collect())


def test_products_are_sampled_and_empty_inputs_fail(spark, sf_small):
    import pytest
    b, o, lines = _gen(spark, sf_small)
    ranks = {r.product_id: i for i, r in enumerate(b["products"].select("product_id").orderBy("product_id").collect())}
    per = lines.toPandas().groupby("order_id").product_id.apply(list)
    per = [p for p in per if len(p) > 1]
    neighbours = sum(abs(ranks[p[0]] - ranks[p[1]]) == 1 for p in per)
    assert len(per) > 20 and neighbours < 0.2 * len(per)
    with pytest.raises(Exception, match="no customers to draw from"):
        X.synthetic_orders(b["orders"], b["customers"].limit(0), b["employees"]).collect()
    with pytest.raises(Exception, match="no products to draw from"):
        X.synthetic_lines(o, b["products"].limit(0)).collect()
    with pytest.raises(Exception, match="no orders to continue from"):
        X.synthetic_orders(b["orders"].limit(0), b["customers"], b["employees"]).collect()
