"""The daily revenue series and the filters over it (P-03…P-07, J-07, F-01).

The series is the day-level total of the wide table: SUM(total_revenue) per
sale_date over all categories.  It is summed from the wide table's exact
decimal revenue (`_rev`), so every statistic downstream is independent of
partitioning.  One row per day: bounded by the calendar, so operators over it
may use un-partitioned windows.  For many series (per category, …) the
functions take `keys` and partition by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT = "_rev"       # exact decimal revenue carried next to the DOUBLE one


def daily_series(wide_exact: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys…, sale_date, total_revenue DOUBLE, _rev DECIMAL), gap-free.
    A wide table without the exact column is summed as DOUBLE."""
    if EXACT not in wide_exact.columns:
        return (wide_exact.groupBy(*keys, "sale_date").agg(F.sum("total_revenue").alias("total_revenue")))
    return (wide_exact.groupBy(*keys, "sale_date").agg(F.sum(EXACT).alias(EXACT))
            .select(*keys, "sale_date", F.col(EXACT).cast("double").alias("total_revenue"), EXACT))


def positive_days(series: DataFrame) -> DataFrame:
    """P-03: only days with revenue > 0 (filter per row, before any grouping)."""
    return series.where(F.col("total_revenue") > 0)


def _with_bounds(series: DataFrame, keys=()) -> DataFrame:
    b = (positive_days(series).groupBy(*keys)
         .agg(F.min("sale_date").alias("_first"), F.max("sale_date").alias("_last")))
    # one row for a single series (broadcast); one row per series otherwise —
    # not bounded, so AQE picks the join from the measured size
    return series.join(b, list(keys), "inner") if keys else series.crossJoin(F.broadcast(b))


def active_period_calendar(series: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """P-04: every day between the first and the last positive day, zero days kept."""
    return (_with_bounds(series, keys).where(F.col("sale_date").between(F.col("_first"), F.col("_last")))
            .drop("_first", "_last"))


def active_period_positive(series: DataFrame, required: bool = False) -> DataFrame:
    """P-05: positive days only — a first/last range filter afterwards is a no-op.
    `required` makes a series without any such day an error (one small job)."""
    out = positive_days(series)
    if required and out.isEmpty():
        raise ValueError("the series has no day with revenue above zero")
    return out


def last_n_days(series: DataFrame, back: int = 180, ahead: int = 30, keys: tuple[str, ...] = ()) -> DataFrame:
    """P-06: view window [last − back, last + ahead] around the last positive day."""
    return (_with_bounds(series, keys)
            .where(F.col("sale_date").between(F.date_sub("_last", back), F.date_add("_last", ahead)))
            .drop("_first", "_last"))


def from_date(series: DataFrame, start) -> DataFrame:
    """P-07: ds >= constant."""
    return series.where(F.col("sale_date") >= F.to_date(F.lit(str(start))))


def missing_dates(present: DataFrame, date_col: str = "sale_date") -> DataFrame:
    """J-07: calendar days between min and max of `present` that are absent."""
    b = present.agg(F.min(date_col).alias("s"), F.max(date_col).alias("e"))
    cal = b.select(F.explode(F.sequence("s", "e", F.expr("INTERVAL 1 DAY"))).alias(date_col))
    return cal.join(present.select(date_col).distinct(), date_col, "left_anti")


def ds_y(series: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """F-01: (ds DATE, y DOUBLE), ordered by ds."""
    return series.select(*keys, F.col("sale_date").cast("date").alias("ds"),
                         F.col("total_revenue").alias("y")).orderBy(*keys, "ds")


def rolling_mean(series: DataFrame, rows: int, value: str = "total_revenue", exact: str | None = EXACT,
                 keys: tuple[str, ...] = ()) -> Column:
    """Mean over the last `rows` rows including the current one (partial windows
    allowed).  With an exact column the sum is exact and divided once."""
    w = Window.partitionBy(*keys).orderBy("sale_date").rowsBetween(-(rows - 1), 0)
    if exact and exact in series.columns:
        return F.sum(exact).over(w).cast("double") / F.count(F.lit(1)).over(w)
    return F.avg(value).over(w)
