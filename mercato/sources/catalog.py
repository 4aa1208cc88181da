"""Tables: declared schemas, overwrite / append, schema alignment,
materialisation and versioned (merge-safe) writes (S-02…S-06, S-10, S-11).

Storage is parquet in a warehouse folder.  The folder defaults to a
subfolder of the shared checkpoint folder (`spark.checkpoint.dir`) so every
executor sees it; pass `root=` for another shared location.  Nothing here
uses a machine-local folder on a cluster.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.session import checkpoint_dir
from mercato.sources.schemas import BRONZE, LAYERS


def warehouse_root(spark: SparkSession, root: str | None = None) -> str:
    if root:
        return root.rstrip("/")
    return f"{checkpoint_dir(spark).rstrip('/')}/mercato-warehouse"


def fresh_root(spark: SparkSession) -> str:
    """A new, empty warehouse folder (one per run — never reuse a live path)."""
    return f"{warehouse_root(spark)}/{uuid.uuid4().hex}"


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def namespace(layer: str, root: str) -> str:
    """The catalog namespace of a layer under `root`: each root has its own, so two
    lakes in one session never share a table."""
    return f"{layer}_{hashlib.md5(root.rstrip('/').encode()).hexdigest()[:12]}"


def ensure_tables(spark: SparkSession, root: str, schemas: dict[str, T.StructType] = BRONZE,
                  layer: str = "bronze") -> list[str]:
    """S-04: create the layer namespaces and the declared tables if absent."""
    for other in LAYERS:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {namespace(other, root)} LOCATION '{root}/{other}.db'")
    ns, made = namespace(layer, root), []
    for name, schema in schemas.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {ns}.{name} ({_ddl(schema)}) USING parquet "
                  f"LOCATION '{root}/{layer}/{name}'")
        made.append(f"{ns}.{name}")
    return made


def align_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """S-05: reorder/cast columns to the target schema; a value that does not
    fit (e.g. 40000 into SMALLINT) fails the job instead of wrapping."""
    return df.to(schema)


def load_full(df: DataFrame, path: str) -> None:
    """S-02: replace all rows of the target."""
    df.write.mode("overwrite").parquet(path)


def load_append(df: DataFrame, path: str) -> None:
    """S-03: add rows, no de-duplication."""
    df.write.mode("append").parquet(path)


def materialize(df: DataFrame, spark: SparkSession, layer: str, name: str, root: str) -> DataFrame:
    """S-06: full-refresh build of a model into `<layer>.<name>`; returns the table.

    The rows are written to a new location, and only then is the table pointed at
    it (one catalog call), so a reader sees the old rows or the new ones, never a
    gap; one that started before goes on with the old files, which stay until
    `sweep`.  A model whose columns changed is declared anew at the new location."""
    path, ns = f"{root}/{layer}/{name}/{uuid.uuid4().hex}", namespace(layer, root)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {ns} LOCATION '{root}/{layer}.db'")
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    if spark.catalog.tableExists(f"{ns}.{name}"):
        if [(f.name, f.dataType) for f in spark.table(f"{ns}.{name}").schema] == [(f.name, f.dataType) for f in df.schema]:
            spark.sql(f"ALTER TABLE {ns}.{name} SET LOCATION '{path}'")
            spark.catalog.refreshTable(f"{ns}.{name}")
            return spark.table(f"{ns}.{name}")
        spark.sql(f"DROP TABLE {ns}.{name}")             # external: only the declaration goes
    spark.sql(f"CREATE TABLE {ns}.{name} USING parquet LOCATION '{path}'")
    return spark.table(f"{ns}.{name}")


def location(spark: SparkSession, layer: str, name: str, root: str) -> str:
    """Where the table's rows lie now."""
    rows = spark.sql(f"DESCRIBE EXTENDED {namespace(layer, root)}.{name}").where("col_name = 'Location'").collect()
    return rows[0].data_type


def sweep(spark: SparkSession, layer: str, name: str, root: str) -> int:
    """Delete the locations a table has left; for when no reader of them is running."""
    P = spark._jvm.org.apache.hadoop.fs.Path
    here, base = location(spark, layer, name, root).rsplit("/", 1)[-1], P(f"{root}/{layer}/{name}")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    left = [st.getPath() for st in fs.listStatus(base) if st.getPath().getName() != here]
    for p in left:
        fs.delete(p, True)
    return len(left)


def materialize_bucketed(df: DataFrame, spark: SparkSession, layer: str, name: str, root: str, key: str, buckets: int) -> DataFrame:
    """A model stored in sorted buckets of `key`: one file per bucket, so tables with
    the same key and number of buckets join on it without an exchange."""
    path, ns = f"{root}/{layer}/{name}/{uuid.uuid4().hex}", namespace(layer, root)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {ns} LOCATION '{root}/{layer}.db'")
    spark.sql(f"DROP TABLE IF EXISTS {ns}.{name}")
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(f"{ns}.{name}"))
    return spark.table(f"{ns}.{name}")


def sample_rows(df: DataFrame, n: int = 10) -> DataFrame:
    """S-10: preview (`LIMIT n`; which rows is unspecified)."""
    return df.limit(n)


def list_tables(spark: SparkSession, root: str, layers=LAYERS) -> DataFrame:
    """S-11: (namespace, table) of the catalog's layers under `root` — metadata only."""
    rows = [(layer, t.name) for layer in layers if spark.catalog.databaseExists(namespace(layer, root))
            for t in spark.catalog.listTables(namespace(layer, root)) if not t.isTemporary]
    return spark.createDataFrame(rows, "namespace string, table_name string")


class VersionedTable:
    """A table stored as numbered versions `<path>/v=<n>/base` (+ `delta-*`).

    `commit(df)` writes version n+1 as a complete new copy (Spark's `_SUCCESS`
    marks it complete) and never touches the version being read, so a merge
    may read the current version and write the next one in the same job.
    `append(df)` adds a delta folder to the current version — only the new
    rows are written (the incremental case).  `current()` reads the newest
    complete version with its committed deltas.  Old versions stay until
    `vacuum(keep)`.

    `month_of` names an INT yyyyMMdd column: rows are then ranged by it and stored by
    its month (`date_month`), so a range of days prunes whole months and, inside
    one, row groups.  `finish` makes the table's columns of the stored ones when it is
    read: long columns that follow from others are neither moved nor stored.
    """

    def __init__(self, spark: SparkSession, path: str, month_of: str | None = None,
                 finish: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.spark, self.path, self.month_of, self.finish = spark, path.rstrip("/"), month_of, finish
        self._prefix = "part=" if month_of else ""        # parts with partitions below are partitions themselves
        jvm = spark._jvm
        self._P = jvm.org.apache.hadoop.fs.Path
        self._fs = self._P(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root = self._P(self.path)
        if not self._fs.exists(root):
            return []
        out = []
        for st in self._fs.listStatus(root):
            name = st.getPath().getName()
            if name.startswith("v=") and self._fs.exists(self._P(st.getPath(), f"{self._prefix}base/_SUCCESS")):
                out.append(int(name[2:]))
        return sorted(out)

    def parts(self) -> list[str]:
        """The folders of the current version: its base and committed deltas."""
        v = self.versions()
        return self._parts(v[-1]) if v else []

    def _parts(self, n: int) -> list[str]:
        root = f"{self.path}/v={n}"
        parts = [f"{root}/{self._prefix}base"]
        for st in self._fs.listStatus(self._P(root)):
            p = st.getPath()
            if st.isDirectory() and p.getName().startswith(f"{self._prefix}delta-") and self._fs.exists(self._P(p, "_SUCCESS")):
                parts.append(p.toString())
        return parts

    def current(self, raw: bool = False) -> DataFrame | None:
        """The current version; `raw` gives the stored columns, `date_month` among them."""
        parts = self.parts()
        if not parts:
            return None
        if self.month_of is None:
            df = self.spark.read.parquet(*parts)
            return df if raw else self.finish(df)
        df = self.spark.read.option("basePath", parts[0].rsplit("/", 1)[0]).parquet(*parts).drop("part")
        return df if raw else self.finish(df.drop("date_month"))

    def _write(self, df: DataFrame, path: str) -> None:
        if self.month_of is None:
            df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
            return
        (df.repartitionByRange(self.month_of).sortWithinPartitions(self.month_of)
         .withColumn("date_month", F.floor(F.col(self.month_of) / 100).cast("int"))
         .write.mode("errorifexists").option("compression", "zstd").partitionBy("date_month").parquet(path))

    def count_rows(self) -> int:
        """Rows of the current version, from the files' footers; 0 without one."""
        current = self.current()
        return current.count() if current is not None else 0

    def compact(self) -> int | None:
        """Write the current version and its deltas as one new version."""
        current = self.current(raw=True)
        return self.commit(current.drop("date_month") if self.month_of else current) if current is not None else None

    def commit(self, df: DataFrame) -> int:
        v = self.versions()
        n = (v[-1] + 1) if v else 1
        self._write(df, f"{self.path}/v={n}/{self._prefix}base")
        return n

    def append(self, df: DataFrame) -> int:
        """Write `df` as a committed delta of the current version (creates version 1
        when there is none) and return its number of rows, told by the files'
        footers; a delta without rows is dropped again.  Readers that listed the
        version before the delta's `_SUCCESS` appeared do not see it."""
        v = self.versions()
        if not v:
            self.commit(df)
            return self.count_rows()
        stored = [c for c in self.current(raw=True).columns if not (self.month_of and c == "date_month")]
        if set(stored) != set(df.columns):                # one read serves all parts
            raise ValueError(f"{self.path} stores {stored}, the rows to append have {df.columns}")
        path = f"{self.path}/v={v[-1]}/{self._prefix}delta-{uuid.uuid4().hex}"
        self._write(df, path)
        n = self.spark.read.schema(df.schema).parquet(path).count()
        if not n:
            self._fs.delete(self._P(path), True)
        return n

    def vacuum(self, keep: int = 2) -> None:
        for n in self.versions()[:-keep]:
            self._fs.delete(self._P(f"{self.path}/v={n}"), True)
