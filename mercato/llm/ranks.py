"""Exact ranks of a distributed sort, and tables stored between steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: its lineage
    ends there, and a lost executor recomputes nothing before it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[Column | str], group: str | None = None, name: str = "ranked") -> DataFrame:
    """`df` with `rank` (0-based place by `order`, within `group` when given) and
    `size` (rows of the group).

    `order` is a total order over the rows; `group` has no nulls.  One range
    exchange by (group, order) splits any group, however large, over tasks; a row's
    place is its place in its partition plus the rows of its group before it, known
    from one row per partition and group.  `df` is read twice (bounds are sampled
    from it), so it should be narrow or stored."""
    keys = [*([F.col(group)] if group else []), *order]
    at = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
          .withColumn("_at", F.monotonically_increasing_id()))
    at = stored(at, name).withColumn("_part", F.shiftright("_at", 33))
    by = [*([group] if group else []), "_part"]
    per = at.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*by[:-1])            # one row per partition of the exchange
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*by, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                     F.sum("_n").over(whole).alias("size"))
    return at.join(per, by).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
