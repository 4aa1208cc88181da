"""Model-run records: write (S-07), read the history (S-08), resolve the
latest run (S-09).

A run record has seven fields.  Records are written by Spark as JSON lines
under `<root>/models/metrics_overall_<stamp>.json/`; the history reader
globs every such entry, skips malformed records, adds the file path and size,
and parses `trained_at` (an unparsable stamp becomes NULL, not an error).
A record may be indented over several lines, as a trainer writes it; files that are
not JSON are routed to `corrupt_records`.  Stamps are read by a chain of formats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.sources.schemas import RUN_RECORD

STAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
STAMP_FORMATS = (STAMP_FORMAT, "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy/MM/dd HH:mm[:ss]", "yyyy-MM-dd HH:mm", "yyyyMMdd_HHmmss", "yyyy-MM-dd")
CORRUPT = "_corrupt"
MODEL_PREFIX, METRICS_PREFIX = "forecast_", "metrics_"


def run_record(metrics: DataFrame, final: DataFrame, stamp: str) -> DataFrame:
    """One record per series: the test metrics of the tuned model and the
    final model's key.  `stamp` is the run time 'yyyyMMdd_HHmmss'."""
    ts = F.to_timestamp(F.lit(stamp), "yyyyMMdd_HHmmss")
    return (metrics.join(final.select("series_key", "last_ds"), "series_key")
            .select(F.concat(F.lit(f"models/{MODEL_PREFIX}"), F.col("series_key"), F.lit(f"_{stamp}"))
                    .alias("model_key"),
                    "mae", "rmse", "mean_test_revenue", "meets_threshold",
                    F.date_format("last_ds", "yyyy-MM-dd").alias("train_end_date"),
                    F.date_format(ts, STAMP_FORMAT).alias("trained_at")))


def write_run_record(record: DataFrame, root: str, stamp: str, indent: bool = False) -> str:
    """S-07: append the run's records as JSON (one small file per run); `indent` writes
    each over several lines."""
    path = f"{root.rstrip('/')}/models/metrics_overall_{stamp}.json"
    fields = [f.name for f in RUN_RECORD.fields]
    if indent:
        record.select(F.to_json(F.struct(*fields), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("append").text(path)
    else:
        record.select(*fields).coalesce(1).write.mode("append").json(path)
    return path


def _records(spark: SparkSession, root: str, multiline: bool) -> DataFrame:
    schema = T.StructType(RUN_RECORD.fields + [T.StructField(CORRUPT, T.StringType())])
    df = (spark.read.schema(schema).option("multiLine", multiline).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
          .json(f"{root.rstrip('/')}/models/metrics_overall_*.json"))
    key = F.regexp_extract(F.col("_metadata.file_path"), r"models/metrics_overall_[^/]*", 0)
    return df.select("*", key.alias("_key"), F.col("_metadata.file_size").alias("_size"))


def training_history(spark: SparkSession, root: str, multiline: bool = True) -> DataFrame:
    """S-08: every readable run record with its key and size, oldest first (a stamp
    that no format reads is NULL and comes last).  `multiline=False` reads files of
    several records, one a line."""
    stamp = F.coalesce(*[F.try_to_timestamp("trained_at", F.lit(f)) for f in STAMP_FORMATS])
    return (_records(spark, root, multiline).where(F.col(CORRUPT).isNull()).drop(CORRUPT)
            .withColumn("trained_at", stamp).orderBy(F.asc_nulls_last("trained_at"), "_key"))


def corrupt_records(spark: SparkSession, root: str, multiline: bool = True) -> DataFrame:
    """What the history left out: key, size and text of every unreadable record."""
    return _records(spark, root, multiline).where(F.col(CORRUPT).isNotNull()).select("_key", "_size", CORRUPT, "mae").drop("mae")


def latest_model(history: DataFrame) -> DataFrame:
    """S-09: the newest run by trained_at (last writer wins, not best MAE) and
    the key of its metrics record."""
    latest = history.where(F.col("trained_at").isNotNull()).agg(
        F.max_by(F.struct("model_key", "trained_at", "mae", "rmse"), "trained_at").alias("r"))
    return latest.select("r.model_key", "r.trained_at", "r.mae", "r.rmse",
                         F.concat(F.replace(F.col("r.model_key"), F.lit(MODEL_PREFIX), F.lit(METRICS_PREFIX)),
                                  F.lit(".json")).alias("metrics_key"))
