"""The day × category tables, kept up at the cost of the change.

Both tables are stored by month (`sale_month`, yyyyMM).  A refresh learns the
days an increment touched from the fact's new parts alone, computes those days
from their own fact partitions, and replaces the months they lie in by dynamic
partition overwrite; the other months' files are not read or written.

A touched day changes the rolling sums of itself and of the 29 days after it, so
the wide table is recomputed for that halo, from the daily rows of the halo and
of the 29 days before it (a frame of 30 consecutive days lies within these).

What else can change a stored day, and what is done:
  * days new to the calendar                 they are computed like touched ones
  * a line's product arrives after the line  the days of lines without a product
                                             are kept (usually none) and become
                                             touched when it arrives
  * a product changes or loses its category  both tables are built anew
  * most days of the calendar are touched    both tables are built anew (cheaper)
  * the set of categories changes            the wide table is built anew

The parts already taken in are listed beside the tables after both are replaced,
so a refresh that is stopped in between is repeated by the next one; repeating
one gives the same rows.  What reaches the driver is bounded by the calendar.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions.keys import fact_key, same_id
from mercato.plans import gold
from mercato.session import checkpoint_dir
from mercato.sources.catalog import VersionedTable

HALO = 29                        # days after a touched one whose 30-day sum holds it
MONTH = "sale_month"


def _months(days: Iterable[dt.date]) -> list[int]:
    return sorted({d.year * 100 + d.month for d in days})


def spread(days: Iterable[dt.date], before: int, after: int) -> set[dt.date]:
    """The days and those up to `before` earlier and `after` later."""
    return {d + dt.timedelta(i) for d in days for i in range(-before, after + 1)}


def days_of_fact(fact: DataFrame, keys: list[int]) -> DataFrame:
    """The fact rows of some days: whole months are pruned by `date_month`, row
    groups by the first and last `date_key`; the days themselves are a semi-join."""
    near = fact.where(F.col("date_month").isin(sorted({k // 100 for k in keys})) & F.col("date_key").between(min(keys), max(keys)))
    days = fact.sparkSession.createDataFrame([(k,) for k in keys], "date_key int")
    return near.join(F.broadcast(days), "date_key", "left_semi")                  # bounded by the calendar


class DailyTables:
    NAMES = ("daily_cat", "wide_exact")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.orphans = VersionedTable(spark, f"{self.root}/daily_orphans")
        self._P = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._P(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- storage
    def _stored(self, name: str) -> DataFrame | None:
        path = f"{self.root}/{name}"
        return self.spark.read.parquet(path) if self._fs.exists(self._P(path)) else None

    def current(self, name: str) -> DataFrame | None:
        df = self._stored(name)
        return df.drop(MONTH) if df is not None else None

    def _write(self, name: str, df: DataFrame, mode: str) -> None:
        """Rows that come from the table they replace ("dynamic") are staged first."""
        df = df.withColumn(MONTH, F.year("sale_date") * 100 + F.month("sale_date"))
        if mode == "dynamic":
            stage = f"{checkpoint_dir(self.spark).rstrip('/')}/daily-{name}-{uuid.uuid4().hex}"
            df.write.parquet(stage)
            df = self.spark.read.parquet(stage)
        (df.repartition(MONTH).sortWithinPartitions("sale_date").write.mode("overwrite")
         .option("partitionOverwriteMode", mode).partitionBy(MONTH).parquet(f"{self.root}/{name}"))

    def _taken(self) -> set[str]:
        path = f"{self.root}/daily_taken"
        return {r.part for r in self.spark.read.parquet(path).collect()} if self._fs.exists(self._P(path)) else set()

    def _take(self, parts: list[str]) -> None:
        self.spark.createDataFrame([(p,) for p in parts], "part string").coalesce(1).write.mode("append").parquet(f"{self.root}/daily_taken")

    # ---- refresh
    def refresh(self, fact: VersionedTable, dim_date: DataFrame, dim_products: DataFrame,
                before: DataFrame | None = None) -> dict[str, int | str]:
        """Bring both tables up to the fact's current version.  `before` is the
        product dimension of the last refresh."""
        names = {"/".join(p.rsplit("/", 2)[1:]): p for p in fact.parts()}
        taken, daily = self._taken(), self._stored("daily_cat")
        new = [n for n in names if n not in taken]
        if daily is None or self._moved(before, dim_products):
            out = self._build(fact.current(raw=True), dim_date, dim_products)
        else:
            out = self._replace_days(fact, [names[n] for n in new], dim_date, dim_products)
        if new:
            self._take(new)
        return out

    @staticmethod
    def _moved(before: DataFrame | None, now: DataFrame) -> bool:
        """A product known before has another category now, or none."""
        if before is None:
            return False
        a = before.select("product_key", F.col("category_name").alias("was"))
        b = now.select("product_key", F.col("category_name").alias("is"))
        return not a.join(b, "product_key", "left").where(~F.col("was").eqNullSafe(F.col("is"))).isEmpty()

    def _build(self, fact: DataFrame, dim_date: DataFrame, dim_products: DataFrame) -> dict[str, int | str]:
        self._write("daily_cat", gold.daily_category_sales(fact, dim_date, dim_products, keep_exact=True), "static")
        self.orphans.commit(self._without_product(fact, dim_products))
        self._build_wide(dim_date, dim_products)
        return {"daily": "built", "wide": "built"}

    def _build_wide(self, dim_date: DataFrame, dim_products: DataFrame) -> None:
        daily = self.current("daily_cat").where(F.col("product_category").isNotNull())
        self._write("wide_exact", gold.wide_sales_forecast(None, dim_date, dim_products, keep_exact=True, daily=daily), "static")

    def _without_product(self, fact: DataFrame, dim_products: DataFrame) -> DataFrame:
        """(product_key, date_key) of lines without a product.  The products that lines
        name are compared first, each once; lines are looked up only where one is
        missing, so as a rule none is shuffled."""
        path = f"{checkpoint_dir(self.spark).rstrip('/')}/daily-missing-{uuid.uuid4().hex}"
        used = fact.select("product_id").distinct()
        used.join(dim_products.select(F.col("product_id").alias("_id")), same_id(used, "product_id"), "left_anti").write.parquet(path)
        missing = self.spark.read.parquet(path).select(F.col("product_id").alias("_id"))
        if missing.isEmpty():
            fact = fact.where("false")
        lines = fact.join(missing, same_id(fact, "product_id"), "left_semi").select("product_id", "date_key").distinct()
        return lines.select(fact_key(lines, "product_key"), "date_key")

    def touched(self, parts: list[str], dim_date: DataFrame, dim_products: DataFrame) -> set[int]:
        """Date keys of the new parts, of lines whose product has arrived, and of
        days that the stored calendar does not have."""
        wide = self._stored("wide_exact").agg(F.min("sale_date").alias("s"), F.max("sale_date").alias("e"))
        days = dim_date.join(F.broadcast(wide)).where(F.col("s").isNull() | ~F.col("full_date").between(F.col("s"), F.col("e"))).select("date_key")
        found = self.orphans.current().join(dim_products.select("product_key"), "product_key", "left_semi").select("date_key")
        days = days.union(found)
        if parts:
            days = days.union(self.spark.read.option("basePath", parts[0].rsplit("/", 1)[0]).parquet(*parts).select("date_key"))
        return {r.date_key for r in days.distinct().collect() if r.date_key is not None}

    def _among(self, days: set[dt.date]) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame([(d,) for d in sorted(days)], "sale_date date"))   # bounded by the calendar

    def _replace_days(self, fact: VersionedTable, parts: list[str], dim_date: DataFrame, dim_products: DataFrame) -> dict[str, int | str]:
        keys = self.touched(parts, dim_date, dim_products)
        calendar = {r.date_key: r.full_date for r in dim_date.select("date_key", "full_date").collect()}
        known = sorted(keys & calendar.keys())
        out: dict[str, int | str] = {"daily": len(known), "wide": 0}
        if not known:
            return out
        if 2 * len(known) > len(calendar):               # cheaper than replacing most of the days
            return self._build(fact.current(raw=True), dim_date, dim_products)
        days = {calendar[k] for k in known}
        lines = days_of_fact(fact.current(raw=True), known)
        fresh = gold.daily_category_sales(lines, dim_date, dim_products, keep_exact=True)
        stay = self._stored("daily_cat").where(F.col(MONTH).isin(_months(days))).drop(MONTH).join(self._among(days), "sale_date", "left_anti")
        self._write("daily_cat", fresh.unionByName(stay), "dynamic")
        still = self.orphans.current().join(F.broadcast(self.spark.createDataFrame([(k,) for k in known], "date_key int")), "date_key", "left_anti")
        self.orphans.commit(still.unionByName(self._without_product(lines, dim_products)))

        cats = dim_products.where(F.col("category_name").isNotNull()).select(F.col("category_name").alias("c")).distinct()
        held = self._stored("wide_exact").select(F.col("product_category").alias("c")).distinct()
        if not cats.exceptAll(held).union(held.exceptAll(cats)).isEmpty():
            self._build_wide(dim_date, dim_products)
            return out | {"wide": "built"}
        halo = spread(days, 0, HALO) & set(calendar.values())
        around = spread(halo, HALO, 0) & set(calendar.values())
        daily = self._stored("daily_cat").where(F.col(MONTH).isin(_months(around)) & F.col("product_category").isNotNull()).drop(MONTH)
        spine = dim_date.join(self._among(around), F.col("full_date") == F.col("sale_date"), "left_semi")
        wide = gold.wide_sales_forecast(None, spine, dim_products, keep_exact=True, daily=daily).join(self._among(halo), "sale_date", "left_semi")
        stay = self._stored("wide_exact").where(F.col(MONTH).isin(_months(halo))).drop(MONTH).join(self._among(halo), "sale_date", "left_anti")
        self._write("wide_exact", wide.unionByName(stay), "dynamic")
        return out | {"wide": len(halo)}
