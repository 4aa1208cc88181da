"""Incremental loading: high-water-mark filter, merge by key, late rows (I-*).

Semantics of the incremental models: on the first run everything is loaded;
later runs take only source rows whose id is above the target's current
maximum (`COALESCE(MAX(id), 0)`), then upsert them by the unique key
(matched → every column replaced, not matched → inserted).  Because the
filter only admits ids above the high-water mark, the merge never matches in
practice: corrections and late rows (id ≤ mark) never arrive — `late_rows`
reports them.

Plan: the mark is one scalar.  `watermark()` fetches it once to the driver so
the filter is a literal that the parquet scan can push down (row groups whose
max id is below the mark are skipped); without a literal the same filter is a
scalar subquery.  The upsert is `anti-join + union` on the key: one shuffle of
the target by key (sort-merge / AQE-skew-split at scale) and no rewrite of
unchanged data beyond that one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def watermark(target: DataFrame | None, id_col: str) -> int:
    """COALESCE(MAX(id), 0) of the target (0 when there is no target yet)."""
    if target is None:
        return 0
    v = target.agg(F.max(id_col)).first()[0]
    return int(v) if v is not None else 0


def watermark_col(target: DataFrame, id_col: str) -> Column:
    """The same mark as a scalar subquery (lazy, evaluated once)."""
    return target.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar()


def incremental_source(source: DataFrame, target: DataFrame | None, id_col: str,
                       mark: int | Column | None = None, source_id: Column | None = None) -> DataFrame:
    """Rows of `source` newer than the target's high-water mark (all rows on a first run)."""
    if target is None:
        return source
    if mark is None:
        mark = watermark_col(target, id_col)
    sid = source_id if source_id is not None else F.col(id_col)
    return source.where(sid > (mark if isinstance(mark, Column) else F.lit(mark)))


def merge_by_key(target: DataFrame | None, updates: DataFrame, key: str | list[str],
                 check: bool = True) -> DataFrame:
    """Upsert `updates` into `target` on `key`.

    Several source rows that match one target row are an error (the MERGE
    contract), raised by the plan itself when it runs; several that match none
    are all inserted.  `check=False` when the key is known to be unique."""
    if target is None:
        return updates
    keys = [key] if isinstance(key, str) else list(key)
    old = target
    if check:
        per = updates.groupBy(*keys).agg(F.count(F.lit(1)).alias("_matches"))
        old = target.join(per, keys, "left")
        what = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
        message = F.concat(F.lit("several source rows match the target row "), what)
        old = old.where(F.when(F.col("_matches") > 1, F.raise_error(message).cast("boolean")).otherwise(F.col("_matches").isNull()))
        kept = old.select(*target.columns)
    else:
        kept = old.join(updates.select(*keys), keys, "left_anti")
    return kept.unionByName(updates.select(*target.columns))


def late_rows(source: DataFrame, target: DataFrame, id_col: str, key: str | list[str],
              mark: int | Column | None = None) -> DataFrame:
    """Source rows at or below the high-water mark that the target does not
    hold — what an id-watermarked load silently never picks up."""
    keys = [key] if isinstance(key, str) else list(key)
    if mark is None:
        mark = watermark_col(target, id_col)
    m = mark if isinstance(mark, Column) else F.lit(mark)
    return source.where(F.col(id_col) <= m).join(target.select(*keys), keys, "left_anti")


def incremental_model(source: DataFrame, target: DataFrame | None, id_col: str, key: str | list[str],
                      mark: int | Column | None = None, key_contains_id: bool = False) -> DataFrame:
    """One incremental run: filter by the mark, then merge by key (the full
    target after the run).  Where the key shows that no row can match
    (`increment_is_append`) the merge is a union: the target is not shuffled."""
    new = incremental_source(source, target, id_col, mark)
    if target is not None and increment_is_append(id_col, key, key_contains_id):
        return target.unionByName(new.select(*target.columns))
    return merge_by_key(target, new, key)


def increment_is_append(id_col: str, key: str | list[str], key_contains_id: bool = False) -> bool:
    """True when the merge of an id-watermarked increment cannot match any
    existing row: the key is the id itself, or is declared to determine it
    (e.g. a hash of (order_id, product_id)).  Every new row's id is above the
    mark, every stored row's id at or below it, so their keys differ."""
    keys = [key] if isinstance(key, str) else list(key)
    return key_contains_id or id_col in keys


def increment(source: DataFrame, target: DataFrame | None, id_col: str,
              mark: int | Column | None = None) -> DataFrame:
    """Only the new rows of a run (what an append-only commit writes)."""
    return incremental_source(source, target, id_col, mark)
