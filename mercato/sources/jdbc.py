"""S-01: full read of a source table over JDBC.

An unpartitioned JDBC read is one task on one connection.  With
`partition_col` (a numeric/date column) and its bounds, Spark issues
`num_partitions` range queries in parallel; the bounds only split the range —
rows outside them still land in the first/last partition, none are dropped.
When the bounds are not given they are fetched with one MIN/MAX query.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession


def _bound(v) -> str:
    return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat() if isinstance(v, dt.date) else str(int(v))


def read_jdbc(spark: SparkSession, url: str, table: str, props: dict | None = None,
              partition_col: str | None = None, num_partitions: int = 8,
              lower: int | dt.date | None = None, upper: int | dt.date | None = None, fetch_size: int = 10_000) -> DataFrame:
    props = dict(props or {})
    props.setdefault("fetchsize", str(fetch_size))
    if not partition_col:
        return spark.read.jdbc(url, table, properties=props)
    if lower is None or upper is None:
        b = spark.read.jdbc(url, f"(SELECT MIN({partition_col}) AS lo, MAX({partition_col}) AS hi "
                                 f"FROM {table}) b", properties=props).first()
        lower, upper = b["lo"], b["hi"]
    if lower is None or upper is None:                    # an empty table, or only NULLs
        return spark.read.jdbc(url, table, properties=props)
    # dates and timestamps go as text, which the reader parses by the column's type
    return (spark.read.format("jdbc").options(**props, url=url, dbtable=table, partitionColumn=partition_col,
                                              lowerBound=_bound(lower), upperBound=_bound(upper),
                                              numPartitions=str(num_partitions)).load())


def read_bronze_tables(spark: SparkSession, url: str, tables: list[str], props: dict | None = None,
                       partition_cols: dict[str, str] | None = None, num_partitions: int = 8) -> dict[str, DataFrame]:
    """The bronze ingest: one (optionally partitioned) read per listed table."""
    partition_cols = partition_cols or {}
    return {t: read_jdbc(spark, url, t, props, partition_cols.get(t), num_partitions) for t in tables}
