"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.session import checkpoint_dir, release, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """What a job with Python tasks needs: this package on every executor."""
    ship_package(spark)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder.

    Spark deletes the shuffle files of a finished step when the driver's garbage
    collector finds that nothing refers to it, by default after half an hour at
    the latest; a job of many steps asks for that here, so that its disk holds
    about one step's shuffles at a time."""
    checkpoint_dir(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (never a machine-local one on a cluster)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"



def packed(df: DataFrame, *names: str) -> DataFrame:
    """Every column inside one struct `_row`, beside copies of the named ones, so
    that no other column's name can clash with an operator's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *names)


def unpacked(columns: list[str], out: str) -> list:
    """The columns of `_row`, less one that carries the result's name."""
    return [F.col(f"_row.`{c}`").alias(c) for c in columns if c != out]
