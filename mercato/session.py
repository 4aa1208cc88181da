"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session of the library wants; a cluster's own values win
# because `getOrCreate` on an existing session ignores builder options.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "mercato", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session. `master=None` keeps whatever the launcher set."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by `spark.checkpoint.dir`.

    On a cluster the launcher sets it to a shared (distributed) folder and we
    only read it.  Only when it is unset — local tests — do we create one.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = d.get() if d.isDefined() else None
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="mercato-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", d)   # remembered for later lookups when allowed
        except Exception:  # noqa: BLE001 — a core setting may be read-only at run time
            pass
    spark.sparkContext.setCheckpointDir(d)
    return d


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to."""
    gc.collect()
    spark._jvm.System.gc()


def ship_package(spark: SparkSession) -> None:
    """Make `mercato` importable in Python workers (needed by applyInPandas).

    Zips the package once per SparkContext into the shared checkpoint folder
    and registers it with `addPyFile`, which distributes it to every executor
    (the usual way to ship code to a cluster)."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_mercato_shipped", False):
        return
    import io
    import uuid

    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    dest = f"{checkpoint_dir(spark).rstrip('/')}/mercato-pkg-{uuid.uuid4().hex}/mercato.zip"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(dest)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(buf.getvalue()))
    out.close()
    sc.addPyFile(dest)
    sc._mercato_shipped = True

