"""Data-quality tests between layers (D-*).  Each test returns its failing
rows — zero rows means pass.  The suite is one DataFrame (model, test,
column, failures): per model one pass per unique key and one for all other tests,
some of which can instead be observed while the model is written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mercato.functions.keys import FACT_KEYS, fact_key, key_ids


def dq_unique(df: DataFrame, col: str) -> DataFrame:
    """D-01: non-null values occurring more than once, with their count."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n_records"))
            .where(F.col("n_records") > 1))


def dq_not_null(df: DataFrame, col: str) -> DataFrame:
    """D-02: rows whose value is NULL."""
    return df.where(F.col(col).isNull())


def dq_relationships(child: DataFrame, col: str, parent: DataFrame, field_: str) -> DataFrame:
    """D-03: child values without a parent row (NULL child values are ignored)."""
    return (child.where(F.col(col).isNotNull()).select(F.col(col).alias("from_field"))
            .join(parent.select(F.col(field_).alias("from_field")), "from_field", "left_anti"))


def dq_unique_combination(df: DataFrame, cols: list[str]) -> DataFrame:
    """D-04: key combinations occurring more than once."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_records")).where(F.col("n_records") > 1)


def dq_expression(df: DataFrame, condition: Column) -> DataFrame:
    """D-05: rows where the expression is not true (NULL counts as not true)."""
    return df.where(~F.coalesce(condition, F.lit(False)))


@dataclass
class ModelTests:
    model: str
    unique: list[str] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    relationships: list[tuple[str, str, str]] = field(default_factory=list)   # (column, parent model, field)
    unique_combination: list[list[str]] = field(default_factory=list)
    expressions: list[tuple[str, object]] = field(default_factory=list)      # (label, f(models) -> Column)


# --- fixed values: the declared test suite of the two layers ---
SILVER_TESTS = [
    ModelTests("stg_orders", unique=["order_id"], not_null=["order_id"]),
    ModelTests("stg_customers", unique=["customer_id"], not_null=["customer_id"]),
    ModelTests("stg_products", unique=["product_id"], not_null=["product_id"]),
    ModelTests("stg_order_details", not_null=["order_id", "product_id"]),
    ModelTests("stg_categories", unique=["category_id"], not_null=["category_id", "category_name"]),
    ModelTests("stg_employees", unique=["employee_id"], not_null=["employee_id"]),
    ModelTests("stg_suppliers", unique=["supplier_id"], not_null=["supplier_id"]),
]
WIDE_MIN_LAST_DATE = "1998-01-01"
GOLD_TESTS = [
    ModelTests("dim_date", unique=["date_key"], not_null=["date_key"]),
    ModelTests("dim_customers", unique=["customer_key"], not_null=["customer_key"]),
    ModelTests("dim_employees", unique=["employee_key"], not_null=["employee_key"]),
    ModelTests("dim_products", unique=["product_key"], not_null=["product_key"]),
    ModelTests("fact_sales", unique=["order_detail_id"], not_null=["order_detail_id"],
               relationships=[("customer_key", "dim_customers", "customer_key"),
                              ("product_key", "dim_products", "product_key"),
                              ("employee_key", "dim_employees", "employee_key")]),
    ModelTests("wide_sales_forecast", not_null=["sale_date", "product_category", "total_revenue"],
               unique_combination=[["sale_date", "product_category"]],
               expressions=[("max_sale_date_recent",
                             lambda m: F.lit(m["wide_sales_forecast"].agg(F.max("sale_date")).scalar()
                                             >= F.to_date(F.lit(WIDE_MIN_LAST_DATE))))]),
]
# ----------------------------------------------------------------


def _null(df: DataFrame, c: str) -> Column:
    return F.count(F.when((F.col(c) if c in df.columns else fact_key(df, c)).isNull(), 1))


def _keyed_tests(df: DataFrame, t: ModelTests, c: str) -> list[DataFrame]:
    """The unique test of a column and, from the same groups, its not-null test.
    A fact's lines without the hash key are grouped by its ids, and a key is never null."""
    n = df.groupBy(*([c] if c in df.columns else key_ids(df, c))).agg(F.count(F.lit(1)).alias("n"))
    null = F.col(c).isNull() if c in df.columns else F.lit(False)
    both = n.agg(F.count(F.when(~null & (F.col("n") > 1), 1)).alias("twice"),
                 F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("missing"))
    rows = [("unique", F.col("twice"))] + ([("not_null", F.col("missing"))] if c in t.not_null else [])
    return [_unpivot(both, t.model, [(test, c, e) for test, e in rows])]


def _unpivot(one: DataFrame, model: str, tests: list[tuple[str, str, Column]]) -> DataFrame:
    """One row per (test, column, failures) of a one-row aggregate, which is planned once."""
    row = lambda test, c, e: F.struct(F.lit(test).alias("test"), F.lit(c).alias("column"), e.cast("bigint").alias("failures"))
    return one.select(F.inline(F.array(*[row(*t) for t in tests]))).select(F.lit(model).alias("model"), "test", "column", "failures")


def _relationship_by_id(lines: DataFrame, model: str, c: str, parent: DataFrame, fld: str) -> DataFrame:
    """The relationships test of a hash key that the lines do not carry."""
    if fld == c and set(FACT_KEYS[c]) <= set(parent.columns):
        one, other = key_ids(lines, c), key_ids(parent, c)
    else:
        one, other = [fact_key(lines, c)], [F.col(fld)]
    n = lines.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(one)]).agg(F.count(F.lit(1)).alias("n"))
    keys = parent.select(*[k.alias(f"_p{i}") for i, k in enumerate(other)])
    same = reduce(Column.__and__, [F.col(f"_k{i}").eqNullSafe(F.col(f"_p{i}")) for i in range(len(one))])
    missing = n.join(keys, same, "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return _unpivot(missing, model, [("relationships", c, F.col("n"))])


def observed(df: DataFrame, t: ModelTests) -> tuple[DataFrame, Callable[[], list[tuple[str, str, str, int]]]]:
    """The model with its not-null tests observed: they are counted while it is
    written, without a scan of their own.  The second value gives their rows
    (model, test, column, failures) once the write has ended."""
    metrics = Observation(f"{t.model}_not_null")
    if not t.not_null:
        return df, lambda: []
    out = df.observe(metrics, *[_null(df, c).alias(c) for c in t.not_null])
    return out, lambda: [(t.model, "not_null", c, int(metrics.get[c])) for c in t.not_null]


def run_suite(models: dict[str, DataFrame], suite: list[ModelTests],
              known: list[tuple[str, str, str, int]] | None = None) -> DataFrame:
    """D-06: one row per declared test with its number of failing rows.

    Per model there is one pass for each unique key (whose groups also tell the
    key's nulls) and one for everything else: not-null tests, expressions and
    relationships, the latter as left joins with the parents' keys whose misses are
    counted in the same aggregate.  `known` holds rows told by `observed`; their
    tests are not run again.  A fact given as its lines, with ids in place of hash keys,
    is tested by the ids: they are a quarter of a key in the shuffle, and one row per id
    and task meets the parents."""
    known = known or []
    told = {(m, c) for m, test, c, _ in known if test == "not_null"}
    spark = next(iter(models.values())).sparkSession
    parts: list[DataFrame] = []
    for t in suite:
        df = models[t.model]
        t = replace(t, not_null=[c for c in t.not_null if (t.model, c) not in told])
        for c in t.unique:
            parts += _keyed_tests(df, t, c)
        counts: list[tuple[str, str, Column]] = [("not_null", c, _null(df, c)) for c in t.not_null if c not in t.unique]
        rows = df
        for i, (c, parent, fld) in enumerate(t.relationships):
            if c not in df.columns:
                parts.append(_relationship_by_id(df, t.model, c, models[parent], fld))
                continue
            keys = models[parent].select(F.col(fld).alias(f"_p{i}")).where(F.col(f"_p{i}").isNotNull()).distinct()
            rows = rows.join(keys, F.col(c) == F.col(f"_p{i}"), "left")
            counts.append(("relationships", c, F.count(F.when(F.col(c).isNotNull() & F.col(f"_p{i}").isNull(), 1))))
        counts += [("expression", label, F.count(F.when(~F.coalesce(make(models), F.lit(False)), 1))) for label, make in t.expressions]
        if counts:
            one = rows.agg(*[e.alias(f"_c{i}") for i, (_, _, e) in enumerate(counts)])
            parts.append(_unpivot(one, t.model, [(test, c, F.col(f"_c{i}")) for i, (test, c, _) in enumerate(counts)]))
        for cols in t.unique_combination:
            n = dq_unique_combination(df, cols).agg(F.count(F.lit(1)).alias("n"))
            parts.append(_unpivot(n, t.model, [("unique_combination", ",".join(cols), F.col("n"))]))
    if known:
        parts.append(spark.createDataFrame(known, "model string, test string, column string, failures bigint"))
    return reduce(DataFrame.unionByName, parts)


def failed(results: DataFrame) -> list[tuple[str, str, str, int]]:
    """Failing tests of a suite result (small: one row per test)."""
    return [tuple(r) for r in results.where(F.col("failures") > 0).collect()]
