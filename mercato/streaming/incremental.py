"""Incremental ingest as a Structured Streaming job.

New bronze files landing in a folder are picked up by a file stream; each
micro-batch is cleaned (a silver model function) and merged into a
versioned target with the high-water-mark rule of the incremental models:

    readStream(parquet, landing) ─► foreachBatch:
        target = current version
        rows   = transform(batch) where id > COALESCE(MAX(target.id), 0)
        commit merge_by_key(target, rows, key) as the next version — or, when
        the key contains the id (no new row can match an old one), append
        only the new rows as a delta of the current version

`trigger(availableNow=True)` processes everything that arrived since the
last run and stops — one scheduled run equals one incremental model run;
without it the same query runs continuously.
Restart safety: the stream checkpoint records which files were processed,
and replaying a batch after a crash is a no-op because its ids are at or
below the mark that its own commit raised.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from mercato.operators import incremental as I
from mercato.sources.catalog import VersionedTable


def merge_batch(target: VersionedTable, transform: Callable[[DataFrame], DataFrame], id_col: str,
                key: str | list[str], key_contains_id: bool = False) -> Callable[[DataFrame, int], None]:
    append_only = I.increment_is_append(id_col, key, key_contains_id)

    def run(batch: DataFrame, epoch_id: int) -> None:
        current = target.current()
        rows = transform(batch)
        mark = I.watermark(current, id_col)             # one scalar → literal filter
        new = I.incremental_source(rows, current, id_col, mark)
        if current is not None and new.isEmpty():
            return                                      # nothing new: no empty delta or version
        if append_only:
            target.append(new)                          # O(new rows): the target is not rewritten
        else:
            target.commit(I.merge_by_key(current, new, key))
    return run


def start_incremental_stream(spark: SparkSession, landing: str, schema: T.StructType, target: VersionedTable,
                             checkpoint: str, transform: Callable[[DataFrame], DataFrame], id_col: str,
                             key: str | list[str], files_per_batch: int | None = None, available_now: bool = True,
                             key_contains_id: bool = False):
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    w = (reader.parquet(landing).writeStream
         .foreachBatch(merge_batch(target, transform, id_col, key, key_contains_id))
         .option("checkpointLocation", checkpoint))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def land(df: DataFrame, landing: str) -> None:
    """Deliver `df` into the watched folder as new files (any number of them).
    Test/driver helper: in production the upstream system lands the files."""
    df.write.mode("append").parquet(landing)


def run_once(spark: SparkSession, landing: str, schema: T.StructType, target: VersionedTable, checkpoint: str,
             transform: Callable[[DataFrame], DataFrame], id_col: str, key: str | list[str]) -> None:
    """One scheduled run: every file that arrived since the last run, as one
    micro-batch (availableNow), merged into the target; returns when done."""
    q = start_incremental_stream(spark, landing, schema, target, checkpoint, transform, id_col, key)
    q.awaitTermination()
