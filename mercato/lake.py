"""`Lake`: the three layers as lazily built DataFrames.

A Lake is created from seven bronze frames (or from the driver's tables via
the adapter) and exposes every silver and gold model as a property.  Nothing
runs until an action: a query over `lake.fact_sales` is one Catalyst plan from
the parquet scans to the result, so column pruning and filter pushdown reach
the files.  `materialize()` writes layers to tables when they are reused.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from mercato.plans import gold, staging
from mercato.sources import driver


class Lake:
    def __init__(self, spark: SparkSession, bronze: dict[str, DataFrame],
                 spine: tuple[str, str] | None = None, audit: bool = False):
        self.spark = spark
        self.bronze = bronze
        self.spine = spine          # None → whole years covering the orders
        self.audit = audit          # add the _ingested_at audit column to silver

    @classmethod
    def from_driver(cls, spark: SparkSession, sf_dir: str, **kw) -> "Lake":
        return cls(spark, driver.bronze_from_driver(spark, sf_dir), **kw)

    # ---- silver ----
    @cached_property
    def stg_orders(self) -> DataFrame:
        return staging.stg_orders(self.bronze["orders"], audit=self.audit)

    @cached_property
    def stg_order_details(self) -> DataFrame:
        return staging.stg_order_details(self.bronze["order_details"], audit=self.audit)

    @cached_property
    def stg_customers(self) -> DataFrame:
        return staging.stg_customers(self.bronze["customers"], audit=self.audit)

    @cached_property
    def stg_products(self) -> DataFrame:
        return staging.stg_products(self.bronze["products"])

    @cached_property
    def stg_categories(self) -> DataFrame:
        return staging.stg_categories(self.bronze["categories"])

    @cached_property
    def stg_employees(self) -> DataFrame:
        return staging.stg_employees(self.bronze["employees"], audit=self.audit)

    @cached_property
    def stg_suppliers(self) -> DataFrame:
        return staging.stg_suppliers(self.bronze["suppliers"])

    # ---- gold ----
    @cached_property
    def dim_customers(self) -> DataFrame:
        return gold.dim_customers(self.stg_customers)

    @cached_property
    def dim_products(self) -> DataFrame:
        return gold.dim_products(self.stg_products, self.stg_categories, self.stg_suppliers)

    @cached_property
    def dim_employees(self) -> DataFrame:
        return gold.dim_employees(self.stg_employees)

    @cached_property
    def dim_date(self) -> DataFrame:
        if self.spine:
            return gold.dim_date(self.spark, *self.spine)
        return gold.dim_date_for(self.stg_orders)

    @cached_property
    def fact_sales(self) -> DataFrame:
        return gold.fact_sales(self.stg_orders, self.stg_order_details)

    @cached_property
    def fact_lines(self) -> DataFrame:
        """The fact with ids where `fact_sales` has hash keys, for the joins and sums over it."""
        return gold.fact_lines(self.stg_orders, self.stg_order_details)

    @cached_property
    def wide_sales_forecast(self) -> DataFrame:
        return gold.wide_sales_forecast(self.fact_lines, self.dim_date, self.dim_products)

    @cached_property
    def wide_exact(self) -> DataFrame:
        """The wide table plus its exact decimal revenue `_rev` (for readers that sum it)."""
        return gold.wide_sales_forecast(self.fact_lines, self.dim_date, self.dim_products, keep_exact=True,
                                        daily=self.daily_cat.where(self.daily_cat.product_category.isNotNull()))

    @cached_property
    def daily_cat(self) -> DataFrame:
        """(sale_date, product_category) aggregate with exact `_rev`, sale days only."""
        return gold.daily_category_sales(self.fact_lines, self.dim_date, self.dim_products, keep_exact=True)

    @cached_property
    def positive_bounds(self) -> DataFrame:
        """One row (mn, mx): first/last positive-revenue day of the wide table.

        Computed from the day × category aggregate (the wide table only adds
        zero rows and drops NULL categories), without building the spine."""
        from mercato.operators.aggregates import date_bounds
        return date_bounds(self.daily_cat.where(self.daily_cat.product_category.isNotNull()))

    SILVER = ("stg_orders", "stg_order_details", "stg_customers", "stg_products", "stg_categories",
              "stg_employees", "stg_suppliers")
    GOLD = ("dim_customers", "dim_products", "dim_employees", "dim_date", "fact_sales", "wide_sales_forecast")

    def model(self, name: str) -> DataFrame:
        return getattr(self, name)

    def create_views(self, names: tuple[str, ...] | None = None) -> list[str]:
        """Register the models as temporary views (`fact_sales`, `dim_date`,
        `wide_sales_forecast`, …) so they can be queried with `spark.sql`."""
        names = names or self.SILVER + self.GOLD
        for n in names:
            self.model(n).createOrReplaceTempView(n)
        return list(names)

    # ---- materialisation ----
    STORED = SILVER + ("dim_customers", "dim_products", "dim_employees", "dim_date", "fact_sales",
                       "daily_cat", "wide_exact")
    # build order: each wave is planned from the stored tables of the waves before it
    WAVES = (SILVER, ("dim_customers", "dim_products", "dim_employees", "dim_date", "fact_sales"),
             ("daily_cat",), ("wide_exact",))

    # silver tables that are joined on a key again and again: stored in buckets of it
    BUCKETED = {"stg_orders": "order_id", "stg_order_details": "order_id"}

    def materialize(self, root: str, threads: int = 4, fact_partition: str | None = None, buckets: int | None = None) -> "Lake":
        """Write silver and gold under `root` (a shared folder) and return a
        Lake whose models read the stored tables.

        Tables are built in dependency waves; the independent tables of a wave
        are written concurrently (`threads` jobs on one session, as a
        model runner runs several models at once).  Each wave is planned from
        the stored output of the previous ones, which also cuts lineage: a lost
        executor recomputes at most one layer.

        Orders and their lines are stored in `buckets` buckets of the order id
        (default: `spark.sql.shuffle.partitions`), sorted, so that their join needs no
        exchange.  The fact is ranged by date key and sorted, so every file holds a
        span of days and a date range skips files and row groups; with
        `fact_partition="date_key"` it is also partitioned by it, and a join with a
        filtered date dimension prunes whole partitions at run time."""
        from concurrent.futures import ThreadPoolExecutor

        from mercato.sources import catalog
        n_buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

        def store(source: "Lake", name: str) -> tuple[str, DataFrame]:
            df = source.model(name)
            path = f"{root.rstrip('/')}/{name}"
            if name in self.BUCKETED:
                return name, catalog.materialize_bucketed(df, self.spark, "silver", name, root.rstrip("/"), self.BUCKETED[name], n_buckets)
            if name == "fact_sales" and fact_partition:
                # rebalanced by the partition value: AQE splits a peak day over several
                # writers and joins small days; columns keep the model's order on read
                cols = df.columns
                (df.hint("rebalance", fact_partition).write.mode("overwrite").partitionBy(fact_partition).parquet(path))
                return name, self.spark.read.parquet(path).select(*cols)
            if name == "fact_sales":
                df = df.repartitionByRange("date_key").sortWithinPartitions("date_key")
            df.write.mode("overwrite").parquet(path)
            return name, self.spark.read.parquet(path)

        tables: dict[str, DataFrame] = {}
        source: Lake = self
        with ThreadPoolExecutor(max_workers=threads) as pool:
            for wave in self.WAVES:
                for name, df in pool.map(lambda n, src=source: store(src, n), wave):
                    tables[name] = df
                source = StoredLake(self.spark, self.bronze, tables, spine=self.spine)
        return source


class StoredLake(Lake):
    """A Lake whose models (those stored so far) are stored tables; the rest
    are planned from them."""

    def __init__(self, spark: SparkSession, bronze: dict[str, DataFrame], tables: dict[str, DataFrame],
                 spine: tuple[str, str] | None = None):
        super().__init__(spark, bronze, spine=spine)
        for name, df in tables.items():
            self.__dict__[name] = df                  # pre-fill the cached properties
        if "fact_sales" in tables:
            self.__dict__["fact_lines"] = tables["fact_sales"]
        if "wide_exact" in tables:
            self.__dict__["wide_sales_forecast"] = tables["wide_exact"].drop("_rev")
