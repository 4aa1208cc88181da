"""Registry of named queries: name → (spark, sf_dir) → DataFrame, and the
matching DuckDB SQL (see `mercato.oracle`).  Every query reads the driver's
tables through the adapter, so its work grows with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mercato import oracle
from mercato.lake import Lake

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_LAKES: dict[tuple[str, str], Lake] = {}


def lake(spark: SparkSession, sf_dir: str) -> Lake:
    """One Lake (lazy plans, no data) per session and data folder: the models
    are defined once and every query builds on the same plan objects, the
    way views are defined once and queried many times."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _LAKES:
        _LAKES[key] = Lake.from_driver(spark, sf_dir)
    return _LAKES[key]


def materialize_lake(spark: SparkSession, sf_dir: str, root: str | None = None) -> Lake:
    """Build silver and gold once into the shared warehouse; every later query
    of this session on `sf_dir` reads the stored tables."""
    from mercato.sources.catalog import fresh_root
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    stored = Lake.from_driver(spark, sf_dir).materialize(root or f"{fresh_root(spark)}/lake")
    _LAKES[key] = stored
    return stored


# ---------------------------------------------------------------- models
def _model_query(model: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lake(spark, sf_dir).model(model)
    q.__name__ = model
    return q


for _m in Lake.SILVER + Lake.GOLD:
    register(_m, oracle.sql(f"SELECT * FROM {_m}"))(_model_query(_m))

# importing the operator modules registers their queries
from mercato import query_defs  # noqa: E402,F401
