"""Scheduled refresh of a stored lake.

The first run builds every model.  Later runs keep the incremental models'
semantics — each takes only rows whose id is above its own stored high-water
mark — and, because the merge key determines the id, the merge is an append:
only the new rows are written, as a committed delta of the current version
(`VersionedTable.append`).  A daily run therefore writes O(new rows) for the big
tables (order lines and the fact), whatever their size.  The small models
(customers, products, …) are rebuilt as a new version.  The fact is stored by
month, and the day × category tables are replaced for the touched days and their
halo only (`plans/daily.py`).

    run 1:  stg_* ← bronze;  fact ← stg_orders ⋈ stg_order_details;  wide ← fact
    run n:  stg_orders        += stg(bronze.orders)        where order_id > mark
            stg_order_details += stg(bronze.order_details) where order_id > mark
            fact_sales        += stg_orders ⋈ details       where order_id > mark(fact)
            daily_cat, wide   := touched days and 29 days after, by dynamic partition overwrite
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.lake import Lake, StoredLake
from mercato.operators import incremental as I
from mercato.plans import gold, staging
from mercato.plans.daily import DailyTables
from mercato.sources.catalog import VersionedTable

# model → (id column of the watermark, merge key); every key here determines its id
INCREMENTAL = {"stg_orders": ("order_id", "order_id"),
               "stg_order_details": ("order_id", "order_detail_id"),
               "fact_sales": ("order_id", "order_detail_id")}
FACT = {"month_of": "date_key", "finish": gold.with_keys}       # lines are moved and stored with ids; keys are made when read
FULL_SILVER = ("stg_customers", "stg_products", "stg_categories", "stg_employees", "stg_suppliers")
FULL_GOLD = ("dim_customers", "dim_products", "dim_employees", "dim_date")


class RefreshedLake:
    def __init__(self, spark: SparkSession, root: str, spine: tuple[str, str] | None = None):
        self.spark, self.root, self.spine = spark, root.rstrip("/"), spine
        self.tables = {n: VersionedTable(spark, f"{self.root}/{n}", **(FACT if n == "fact_sales" else {}))
                       for n in (*INCREMENTAL, *FULL_SILVER, *FULL_GOLD)}
        self.daily = DailyTables(spark, self.root)

    def current(self) -> StoredLake:
        return self._without(())

    def _without(self, names: tuple[str, ...]) -> StoredLake:
        """The stored lake, with the named tables planned anew."""
        stored = {n: t.current() for n, t in self.tables.items() if n not in names and t.versions()}
        days = {n: self.daily.current(n) for n in DailyTables.NAMES}
        return StoredLake(self.spark, {}, stored | {n: df for n, df in days.items() if df is not None}, spine=self.spine)

    def run(self, bronze: dict[str, DataFrame]) -> dict[str, int | str]:
        """One scheduled run; returns the number of rows written per incremental model
        and of days replaced in the day × category tables ("built": all of them)."""
        first = not self.tables["stg_orders"].versions()
        written: dict[str, int | str] = {}
        src = Lake(self.spark, bronze, spine=self.spine)

        for name in FULL_SILVER:
            self.tables[name].commit(src.model(name))

        fresh = {"stg_orders": staging.stg_orders(bronze["orders"], audit=False),
                 "stg_order_details": staging.stg_order_details(bronze["order_details"], audit=False)}
        for name in ("stg_orders", "stg_order_details"):
            written[name] = self._append_new(name, fresh[name])

        products = self.tables["dim_products"].current()             # as the last run left them
        lk = self._without(FULL_GOLD)
        for name in FULL_GOLD:
            self.tables[name].commit(lk.model(name))

        lk = self._without(("fact_sales",))
        new_fact = gold.fact_lines(lk.stg_orders, lk.stg_order_details)
        written["fact_sales"] = self._append_new("fact_sales", new_fact)

        lk = self.current()
        written |= self.daily.refresh(self.tables["fact_sales"], lk.dim_date, lk.dim_products, products)
        written["first_run"] = int(first)
        return written

    def _append_new(self, name: str, rows: DataFrame) -> int:
        id_col, key = INCREMENTAL[name]
        assert I.increment_is_append(id_col, key, key_contains_id=True)
        table = self.tables[name]
        current = table.current()
        mark = I.watermark(current, id_col)              # literal: pushed to the scans
        return table.append(I.increment(rows, current, id_col, mark))


def first_delivery(bronze: dict[str, DataFrame], orders: DataFrame) -> dict[str, DataFrame]:
    """The bronze tables as an earlier delivery saw them: the given orders and
    their lines (every other table whole)."""
    out = dict(bronze.items())
    out["orders"] = orders
    out["order_details"] = bronze["order_details"].join(orders.select("order_id"), "order_id", "left_semi")
    return out
