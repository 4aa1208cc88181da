"""Synthetic order generation (X-03 / X-04), distributed and reproducible.

New orders start the day after the latest order and take ids after the
largest id.  Per day the order count is max(1, int(N(avg, avg/4))); each
order gets a uniform customer and employee, required date +7..21 days,
shipped +1..7 days, freight U(5, 120); each order has 1..max_lines distinct
products, price = base × U(0.9, 1.1) (U(5, 60) when the base is not
positive), quantity 1..30 and a discount drawn from a fixed list.

Every random draw is made of md5 digits of (seed, field, id), so the output
depends only on the seed and the inputs — not on partitioning, task order or
engine: the SQL twins draw the same numbers.  (It cannot reproduce any
particular PRNG stream.)  Dimension rows are picked by a dense index (ranks
inside md5 buckets) and joined to the generated rows by that index; nothing
generated is broadcast.  Empty customers, employees
or products, and orders without a date to continue from, are errors.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.keys import md5_uniform as uniform
from mercato.functions.keys import with_dense_index

# --- fixed values ---
DISCOUNTS = (0.0, 0.0, 0.0, 0.05, 0.10, 0.15, 0.20, 0.25)
SHIP_VIAS = (1, 2, 3)
REQUIRED_DAYS, SHIPPED_DAYS = (7, 21), (1, 7)
FREIGHT, BASE_PRICE, PRICE_FACTOR, QUANTITY = (5.0, 120.0), (5.0, 60.0), (0.9, 1.1), (1, 30)
DEFAULTS = {"days": 30, "per_day": 12, "max_lines": 4, "seed": 42}
# --------------------


def _randint(u, lo: int, hi: int):
    """integer in [lo, hi] from U[0,1)"""
    return (F.floor(u * (hi - lo + 1)) + lo).cast("int")


def _count_of(df: DataFrame, what: str):
    """The row count as a scalar; an empty frame is an error (one row is looked for)."""
    if df.isEmpty():
        raise ValueError(f"no {what} to draw from")
    return df.agg(F.count(F.lit(1))).scalar()


def synthetic_orders(orders: DataFrame, customers: DataFrame, employees: DataFrame,
                     days: int = 30, per_day: int = 12, seed: int = 42) -> DataFrame:
    """X-03: new bronze orders (bronze `orders` columns)."""
    spark = orders.sparkSession
    if orders.where("order_date IS NOT NULL").isEmpty():
        raise ValueError("no orders to continue from")
    b = orders.agg((F.coalesce(F.max("order_id"), F.lit(0)) + 1).alias("next_id"), F.date_add(F.max("order_date"), 1).alias("start_day"))
    d = spark.range(days).select(F.col("id").cast("int").alias("day_no"))
    u1, u2 = uniform(seed, "n1", F.col("day_no")), uniform(seed, "n2", F.col("day_no"))
    gauss = F.sqrt(-2.0 * F.log(F.greatest(u1, F.lit(1e-300)))) * F.cos(2 * math.pi * u2)   # Box-Muller
    n = F.greatest(F.lit(1), (F.lit(per_day) + gauss * (per_day * 0.25)).cast("int"))
    d = d.select("day_no", n.alias("n_orders"))
    # ids are consecutive: running total over the day frame (one row per day, bounded by
    # `days`), joined back to the days so that the orders are made in many tasks
    before = d.select(F.col("day_no").alias("_day"), (F.sum("n_orders").over(Window.orderBy("day_no")) - F.col("n_orders"))
                      .alias("before"))
    o = (d.join(F.broadcast(before), F.col("day_no") == F.col("_day")).crossJoin(F.broadcast(b))
         .select(F.date_add("start_day", F.col("day_no")).alias("order_date"),
                 F.explode(F.sequence(F.lit(0), F.col("n_orders") - 1)).alias("k"), "before", "next_id")
         .select("order_date", (F.col("next_id") + F.col("before") + F.col("k")).alias("order_id")))
    nc, ne = _count_of(customers, "customers"), _count_of(employees, "employees")
    oid = F.col("order_id")
    o = o.select("order_id", "order_date",
                 F.floor(uniform(seed, "cust", oid) * nc).alias("_ci"),
                 F.floor(uniform(seed, "emp", oid) * ne).alias("_ei"),
                 F.date_add("order_date", _randint(uniform(seed, "req", oid), *REQUIRED_DAYS)).alias("required_date"),
                 F.date_add("order_date", _randint(uniform(seed, "ship", oid), *SHIPPED_DAYS)).alias("shipped_date"),
                 F.element_at(F.array(*[F.lit(v) for v in SHIP_VIAS]),
                              _randint(uniform(seed, "via", oid), 1, len(SHIP_VIAS))).alias("ship_via"),
                 F.round(F.lit(FREIGHT[0]) + uniform(seed, "freight", oid) * (FREIGHT[1] - FREIGHT[0]), 2).alias("freight"),
                 F.concat(F.lit("Consignee "), oid.cast("string")).alias("ship_name"),
                 F.concat(_randint(uniform(seed, "addr", oid), 1, 999).cast("string"), F.lit(" Harbour Road"))
                 .alias("ship_address"),
                 F.lit("Newbridge").alias("ship_city"), F.lit(None).cast("string").alias("ship_region"),
                 _randint(uniform(seed, "zip", oid), 10000, 99999).cast("string").alias("ship_postal_code"),
                 F.lit("Nowhere").alias("ship_country"))
    c = with_dense_index(customers.select("customer_id"), "_ci", "customer_id")
    e = with_dense_index(employees.select("employee_id"), "_ei", "employee_id")
    out = o.join(c, "_ci").join(e, "_ei")
    cols = ["order_id", "customer_id", "employee_id", "order_date", "required_date", "shipped_date", "ship_via",
            "freight", "ship_name", "ship_address", "ship_city", "ship_region", "ship_postal_code", "ship_country"]
    return out.select(*cols)


def synthetic_lines(new_orders: DataFrame, products: DataFrame, max_lines: int = 4, seed: int = 42) -> DataFrame:
    """X-04: 1..max_lines distinct products per new order (bronze `order_details`)."""
    npr = _count_of(products, "products")
    oid = F.col("order_id")
    k = F.least(_randint(uniform(seed, "lines", oid), 1, max_lines), F.lit(npr))
    # independent draws, repeats rejected; the run of indexes at the end only fills up
    # when so many draws repeat each other that too few are left
    draws = F.transform(F.sequence(F.lit(1), F.lit(8 * max_lines)), lambda i: F.floor(uniform(seed, "prod", oid, i) * F.col("_np")))
    rest = F.transform(F.sequence(F.lit(0), F.lit(max_lines - 1)), lambda i: (F.element_at(draws, 1) + i) % F.col("_np"))
    picked = F.slice(F.array_distinct(F.concat(draws, rest)), 1, F.col("_k"))
    lines = (new_orders.select("order_id", k.alias("_k"), npr.alias("_np"))
             .select("order_id", F.posexplode(picked).alias("line", "_pi")))
    p = with_dense_index(products.select("product_id", "unit_price"), "_pi", "product_id")
    j = lines.join(p, "_pi")
    key = [oid, F.col("line")]
    base = F.coalesce(F.col("unit_price"), F.lit(0.0))
    price = F.when(base > 0, F.round(base * (F.lit(PRICE_FACTOR[0]) + uniform(seed, "price", *key) * (PRICE_FACTOR[1] - PRICE_FACTOR[0])), 2)) \
        .otherwise(F.round(F.lit(BASE_PRICE[0]) + uniform(seed, "price", *key) * (BASE_PRICE[1] - BASE_PRICE[0]), 2))
    disc = F.element_at(F.array(*[F.lit(v) for v in DISCOUNTS]), _randint(uniform(seed, "disc", *key), 1, len(DISCOUNTS)))
    return j.select("order_id", "product_id", price.alias("unit_price"),
                    _randint(uniform(seed, "qty", *key), *QUANTITY).alias("quantity"), disc.alias("discount"))
