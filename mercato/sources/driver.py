"""Adapter: the driver's TPC-H-like tables → the seven bronze tables.

The retail model expects a classic order-entry source (orders, order lines,
products, categories, suppliers, employees, customers).  The driver ships a
TPC-H-like star instead, so each bronze table is derived here, lazily, with
plain DataFrame operations:

  orders         orders; the order's sales agent (`employee_id`) is the
                 smallest supplier key among its lines and `shipped_date` its
                 last line ship date (one partial-aggregated pass over lines);
                 no freight exists in the source → 0.0
  order_details  lineitem; unit_price = extendedprice / quantity rounded half
                 up to cents, computed once here
  products       part; category = p_type, supplier = smallest supplier key
                 that sold the part
  categories     distinct p_type, id = dense rank of the name
  suppliers      supplier ⋈ nation, one row per supplier key
  employees      the same (a supplier stands in as sales agent)
  customers      customer ⋈ nation ⋈ region

Every column the bronze schema declares is present (unknown ones as typed
NULL), so `align_to_schema` accepts the frames unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.sources.schemas import BRONZE

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A plain scan: how it splits is up to the table's layout and `spark.sql.files.*`,
    so the plan has the same shape at every size."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _fill(df: DataFrame, table: str) -> DataFrame:
    """Project to the declared bronze schema; absent columns become typed NULLs."""
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in BRONZE[table].fields]
    return df.select(*cols)


def bronze_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_driver(spark, sf_dir, "orders")
    per_order = (read_driver(spark, sf_dir, "lineitem")
                 .groupBy(F.col("l_orderkey").alias("order_id"))
                 .agg(F.min("l_suppkey").alias("employee_id"),
                      F.to_date(F.max("l_shipdate")).alias("shipped_date")))
    df = (o.select(F.col("o_orderkey").alias("order_id"),
                   F.col("o_custkey").cast("string").alias("customer_id"),
                   F.to_date("o_orderdate").alias("order_date"),
                   F.lit(0.0).alias("freight"))
          .join(per_order, "order_id", "left"))
    return _fill(df, "orders")


def one_line_per_product(lines: DataFrame) -> DataFrame:
    """Of the lines with one order and part the first by supplier, number and ship
    date (with these, the five columns name a line), as an order-entry source has it."""
    order = ("l_suppkey", "l_linenumber", "l_shipdate")
    rest = [c for c in lines.columns if c not in ("l_orderkey", "l_partkey", *order)]
    first = F.min(F.struct(*order, *rest))                 # a line travels once, with what orders it in front
    return lines.groupBy("l_orderkey", "l_partkey").agg(first.alias("r")).select(
        *[c if c in ("l_orderkey", "l_partkey") else F.col(f"r.{c}") for c in lines.columns])


def bronze_order_details(spark: SparkSession, sf_dir: str, distinct_products: bool = False) -> DataFrame:
    li = read_driver(spark, sf_dir, "lineitem")
    if distinct_products:
        li = one_line_per_product(li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate",
                                            "l_quantity", "l_extendedprice", "l_discount"))
    df = li.select(F.col("l_orderkey").alias("order_id"),
                   F.col("l_partkey").alias("product_id"),
                   (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100).alias("unit_price"),
                   F.col("l_quantity").cast("int").alias("quantity"),
                   F.col("l_discount").alias("discount"))
    return _fill(df, "order_details")


def bronze_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    # distinct first (partial aggregation), so the un-partitioned rank window
    # only ever sees one row per category name
    types = read_driver(spark, sf_dir, "part").select(F.col("p_type").alias("category_name")).distinct()
    df = types.select(F.dense_rank().over(Window.orderBy("category_name")).alias("category_id"),
                      "category_name",
                      F.concat(F.lit("Parts of type "), F.col("category_name")).alias("description"))
    return _fill(df, "categories")


def bronze_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_driver(spark, sf_dir, "part")
    seller = (read_driver(spark, sf_dir, "lineitem")
              .groupBy(F.col("l_partkey").alias("product_id"))
              .agg(F.min("l_suppkey").alias("supplier_id")))
    cats = bronze_categories(spark, sf_dir).select("category_id", F.col("category_name").alias("p_type"))
    df = (part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
                      "p_type", F.col("p_retailprice").alias("unit_price"),
                      F.lit(0).alias("discontinued"))
          .join(cats, "p_type", "left")
          .join(seller, "product_id", "left"))
    return _fill(df, "products")


def _supplier_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier key.  The aggregate states the key's uniqueness in
    the plan, so Catalyst can drop a left join to suppliers whose columns a
    query does not use (and, behind it, the lines pass that finds each part's
    supplier)."""
    s = read_driver(spark, sf_dir, "supplier")
    n = read_driver(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (s.join(n, s.s_nationkey == n.n_nationkey, "left")
            .groupBy("s_suppkey").agg(F.min("s_name").alias("s_name"), F.min("n_name").alias("n_name")))


def bronze_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _supplier_nation(spark, sf_dir).select(F.col("s_suppkey").alias("supplier_id"),
                                                F.col("s_name").alias("company_name"),
                                                F.col("n_name").alias("country"))
    return _fill(df, "suppliers")


def bronze_employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _supplier_nation(spark, sf_dir).select(F.col("s_suppkey").alias("employee_id"),
                                                F.lit("Agent").alias("first_name"),
                                                F.col("s_name").alias("last_name"),
                                                F.lit("Sales Representative").alias("title"),
                                                F.col("n_name").alias("country"))
    return _fill(df, "employees")


def bronze_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_driver(spark, sf_dir, "customer")
    n = read_driver(spark, sf_dir, "nation")
    r = read_driver(spark, sf_dir, "region")
    df = (c.join(n, c.c_nationkey == n.n_nationkey, "left")
          .join(r, n.n_regionkey == r.r_regionkey, "left")
          .select(F.col("c_custkey").cast("string").alias("customer_id"),
                  F.col("c_name").alias("company_name"),
                  F.col("n_name").alias("country"),
                  F.col("r_name").alias("region")))
    return _fill(df, "customers")


BUILDERS = {
    "orders": bronze_orders, "order_details": bronze_order_details, "products": bronze_products,
    "categories": bronze_categories, "suppliers": bronze_suppliers, "employees": bronze_employees,
    "customers": bronze_customers,
}


class LazyTables(dict):
    """A dict of bronze frames built on first access (a query touching two
    tables does not plan — or list the files of — the other five)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._spark, self._dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        df = BUILDERS[name](self._spark, self._dir)
        self[name] = df
        return df

    def keys(self):
        return BUILDERS.keys()

    def items(self):
        return [(n, self[n]) for n in BUILDERS]

    def __iter__(self):
        return iter(BUILDERS)

    def __len__(self):
        return len(BUILDERS)


def bronze_from_driver(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return LazyTables(spark, sf_dir)
