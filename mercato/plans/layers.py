"""D-07: the layered run — bronze → silver → silver tests → gold → gold
tests → forecast — stopping at the first failing stage.

Each layer is materialised (written, then read back) before the next one is
built: that cuts lineage, so a lost executor re-runs one layer, not the whole
chain, and every test reads the stored table.  The fact is stored as its lines, with
ids; its hash keys and each line's revenue are made when it is read (`gold.with_keys`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from mercato.lake import Lake
from mercato.operators import quality as Q
from mercato.plans import gold
from mercato.session import release
from mercato.sources import catalog


@dataclass
class StageResult:
    stage: str
    status: str          # ok | failed | skipped
    detail: str = ""


STAGES = ("bronze", "silver", "silver_tests", "gold", "gold_tests", "forecast")
MARK = "stage string, status string, detail string, layer string, name string, path string"


class _Marks:
    """Beside the tables, what each finished stage said and where its tables lie: a
    run started again on the same root goes on after the last stage that was ok."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root}/_stages"
        self._P = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._P(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self, stage: str) -> tuple[StageResult, dict[str, str]] | None:
        if not self._fs.exists(self._P(f"{self.root}/{stage}/_SUCCESS")):
            return None
        rows = self.spark.read.schema(MARK).parquet(f"{self.root}/{stage}").collect()
        if rows[0].status != "ok":
            return None
        return StageResult(stage, "ok", rows[0].detail), {r.name: r.path for r in rows if r.name}

    def write(self, result: StageResult, placed: dict[str, tuple[str, str]]) -> None:
        head = (result.stage, result.status, result.detail)
        rows = [(*head, layer, name, path) for name, (layer, path) in placed.items()] or [(*head, None, None, None)]
        self.spark.createDataFrame(rows, MARK).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{result.stage}")


def run_layers(spark: SparkSession, bronze: dict[str, DataFrame], root: str | None = None,
                 forecast=None, stop_on_failure: bool = True) -> tuple[list[StageResult], dict[str, DataFrame]]:
    """Run all stages; `forecast(models) -> DataFrame` is the optional last stage.
    Returns the stage log and the materialised tables.

    Not-null tests are observed while a layer is written.  With the `root` of an
    earlier run, stages that had ended ok are not repeated: their tables are read."""
    root = (root or catalog.fresh_root(spark)).rstrip("/")
    marks, log, stored, tables = _Marks(spark, root), [], {}, {}
    known: list = []

    def placed_at(name: str, df: DataFrame) -> None:
        stored[name], tables[name] = df, gold.with_keys(df) if name == "fact_sales" else df

    def models(stage: str, layer: str, frames, tests=()) -> None:
        kept = marks.read(stage)
        if kept:
            log.append(kept[0])
            for n, p in kept[1].items():
                placed_at(n, spark.read.parquet(p))
            return
        placed, by_model = {}, {t.model: t for t in tests}
        for name, df in frames():
            tell = None
            if name in by_model:
                df, tell = Q.observed(df, by_model[name])
            placed_at(name, catalog.materialize(df, spark, layer, name, root))
            release(spark)                                  # a stored table needs the shuffles behind it no longer
            known.extend(tell() if tell else [])
            placed[name] = (layer, catalog.location(spark, layer, name, root))
        log.append(StageResult(stage, "ok", f"{len(placed)} tables"))
        marks.write(log[-1], placed)

    def tests(stage: str, suite) -> bool:
        """False when the run has to stop."""
        kept = marks.read(stage)
        if kept:
            log.append(kept[0])
            return True
        names = {t.model for t in suite}
        bad = Q.failed(Q.run_suite(stored, suite, [k for k in known if k[0] in names]))
        log.append(StageResult(stage, "failed" if bad else "ok", repr(bad)))
        marks.write(log[-1], {})
        release(spark)
        return not (bad and stop_on_failure)

    models("bronze", "bronze", lambda: bronze.items())
    bronze_lake = Lake(spark, dict(stored))
    models("silver", "silver", lambda: ((n, bronze_lake.model(n)) for n in Lake.SILVER), Q.SILVER_TESTS)
    if not tests("silver_tests", Q.SILVER_TESTS):
        return _skip(log, ["gold", "gold_tests", "forecast"]), tables

    silver = _SilverLake(spark, stored)

    def gold_models():
        for n in Lake.GOLD:
            yield n, silver.fact_lines if n == "fact_sales" else silver.model(n)
            if n == "fact_sales":
                silver.__dict__["fact_lines"] = stored[n]   # what follows reads the stored lines
    models("gold", "gold", gold_models, Q.GOLD_TESTS)
    if not tests("gold_tests", Q.GOLD_TESTS):
        return _skip(log, ["forecast"]), tables

    if forecast is not None:
        kept = marks.read("forecast")
        if kept:
            tables["forecast"] = spark.read.parquet(kept[1]["forecast"])
            log.append(kept[0])
        else:
            tables["forecast"] = catalog.materialize(forecast(tables), spark, "gold", "forecast", root)
            m = tables["forecast"].collect()          # one row per series
            log.append(StageResult("forecast", "ok", repr([(r.series_key, round(r.mae, 2), r.meets_threshold) for r in m])))
            marks.write(log[-1], {"forecast": ("gold", catalog.location(spark, "gold", "forecast", root))})
    return log, tables


def forecast_stage(spark: SparkSession):
    """The retrain stage: overall daily series of the stored wide table,
    positive days, split / grid / evaluate / final fit; returns the metrics."""
    def run(tables: dict[str, DataFrame]) -> DataFrame:
        from mercato.operators import forecast as FC
        from mercato.operators import series as S
        s = FC.prepare_series(S.positive_days(S.daily_series(tables["wide_sales_forecast"])))
        return FC.train(spark, s)["metrics"]
    return run


def _skip(log: list[StageResult], stages: list[str]) -> list[StageResult]:
    return log + [StageResult(s, "skipped") for s in stages]


class _SilverLake(Lake):
    """A Lake whose silver models are the stored silver tables."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], spine=None):
        super().__init__(spark, {}, spine=spine)
        for name in Lake.SILVER:
            self.__dict__[name] = tables[name]     # pre-fill the cached properties
