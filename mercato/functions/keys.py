"""Key and calendar helpers: hash surrogate keys, smart date keys, date spines."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values (must equal the modelling convention the gold layer follows) ---
# Text that stands for a NULL part before hashing, and the separator between parts.
SURROGATE_NULL_TOKEN = "_dbt_utils_surrogate_key_null_"
SURROGATE_SEPARATOR = "-"
# -------------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def surrogate_key(*cols) -> Column:
    """md5 hex of the string casts of `cols` joined by '-', NULL parts replaced
    by a fixed token (so the key itself is never NULL)."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(SURROGATE_SEPARATOR))
        parts.append(F.coalesce(_col(c).cast("string"), F.lit(SURROGATE_NULL_TOKEN)))
    return F.md5(F.concat(*parts))


# the fact's hash keys and the ids they are made of; lines carry the ids alone
FACT_KEYS = {"order_detail_id": ("order_id", "product_id"), "customer_key": ("customer_id",),
             "product_key": ("product_id",), "employee_key": ("employee_id",)}


def fact_key(fact: DataFrame, key: str) -> Column:
    """A hash key of the fact: its column, or made of the ids where the fact still carries them."""
    return (F.col(key) if key in fact.columns else surrogate_key(*FACT_KEYS[key])).alias(key)


def key_ids(df: DataFrame, key: str) -> list[Column]:
    """The ids behind a hash key, alike where the keys are: numbers, or one text."""
    return [F.coalesce(F.col(i), F.lit(SURROGATE_NULL_TOKEN)) if isinstance(df.schema[i].dataType, T.StringType) else F.col(i) for i in FACT_KEYS[key]]


def same_id(fact: DataFrame, id_: str) -> Column:
    """The fact's id is `_id`: equal ids have equal keys, two NULL ids too."""
    if isinstance(fact.schema[id_].dataType, T.StringType):        # a text may be what stands for NULL
        name = lambda c: F.coalesce(F.col(c), F.lit(SURROGATE_NULL_TOKEN))
        return name(id_) == name("_id")
    return F.col(id_).eqNullSafe(F.col("_id"))


def join_dim(fact: DataFrame, dim: DataFrame, key: str, *cols: str) -> DataFrame:
    """Inner join of the fact with columns of a dimension on one of its hash keys.

    Where both carry the id behind the key they are joined on it: it is a quarter of
    a key in the shuffle."""
    id_, = FACT_KEYS[key]
    if key in fact.columns or id_ not in dim.columns:
        return fact.withColumn(key, fact_key(fact, key)).join(dim.select(key, *cols), key)
    return fact.join(dim.select(F.col(id_).alias("_id"), *cols), same_id(fact, id_)).drop("_id")


def without_dim(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """The lines whose hash key no row of the dimension has.  Lines without the key's
    column are compared by the id behind it, so that no key is made before the shuffle."""
    id_, = FACT_KEYS[key]
    return fact.join(dim.select(F.col(id_).alias("_id")), same_id(fact, id_), "left_anti")


def date_key(c) -> Column:
    """yyyyMMdd as INT (smart date key)."""
    return F.date_format(_col(c), "yyyyMMdd").cast("int")


def _as_date(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, (_dt.date, _dt.datetime)):
        v = v.strftime("%Y-%m-%d")
    return F.to_date(F.lit(v))


def date_spine(spark: SparkSession, start, end, name: str = "date_day") -> DataFrame:
    """One row per day in [start, end) — end exclusive.

    `start`/`end` are literals (str/date).  The spine is generated from a
    single row with `explode(sequence(...))`; it is bounded by the number of
    days, not by data volume.
    """
    s, e = _as_date(start), _as_date(end)
    return (spark.range(1)
            .select(F.explode(F.sequence(s, F.date_sub(e, 1), F.expr("INTERVAL 1 DAY"))).alias(name))
            .where(F.col(name) < e))


def spine_from_bounds(bounds: DataFrame, start_col: str, end_col: str, name: str = "date_day") -> DataFrame:
    """Spine over [start, end) where the bounds come from a one-row DataFrame
    (e.g. an aggregate) — stays lazy, no driver round trip."""
    return (bounds.select(F.explode(F.sequence(F.col(start_col), F.date_sub(F.col(end_col), 1),
                                               F.expr("INTERVAL 1 DAY"))).alias(name),
                          F.col(end_col).alias("_end"))
            .where(F.col(name) < F.col("_end")).drop("_end"))


def with_dense_index(df: DataFrame, name: str = "_idx", key: str | None = None, digits: int = 3) -> DataFrame:
    """Attach a dense 0-based index that depends only on the rows, not on how
    they are partitioned, without a single-partition window: the rank by (bucket,
    key), where the bucket is the first `digits` hex digits of the key's md5.

    Inside a bucket rows are ranked by the key (a window partitioned by bucket,
    16^digits parallel sorts); a bucket's offset is the running total of the
    sizes of the buckets before it (one aggregate, a row per bucket, broadcast
    back).  Keys must be unique for the index to be unique.  Any engine with md5
    can give the same index by one ORDER BY."""
    from pyspark.sql import Window

    key = key or df.columns[0]
    b = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, digits).alias("_b")
    tmp = df.select("*", b)
    tmp = tmp.select("*", F.row_number().over(Window.partitionBy("_b").orderBy(key)).alias("_r"))
    sizes = df.groupBy(b).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (tmp.join(F.broadcast(offsets), "_b")                 # at most 16^digits rows
            .withColumn(name, F.col("_off") + F.col("_r") - 1).drop("_b", "_r", "_off"))


def uniform(seed: int, *parts) -> Column:
    """Deterministic U[0,1) from a hash of (seed, parts…) — the same value for
    the same key whatever the partitioning."""
    h = F.xxhash64(F.lit(seed), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (h.bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(float(1 << 53)))


def md5_uniform(seed: int, what: str, *parts: Column) -> Column:
    """Deterministic U[0,1) from the md5 of `seed:what:part:…` (its first 13 hex
    digits, 52 bits): the same number in any engine that has md5."""
    text = F.concat(F.lit(f"{seed}:{what}"), *[x for p in parts for x in (F.lit(":"), p.cast("string"))])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))
