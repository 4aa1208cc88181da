"""SQL screening: the reference's 20 cases as rows, plus the known false
positives; the Spark result is also cross-checked against the DuckDB form."""

import duckdb
import pytest

from mercato import oracle
from mercato.operators import screening as R

OK = [
    ("SELECT * FROM iceberg.gold.fact_sales LIMIT 10", "SELECT * FROM iceberg.gold.fact_sales LIMIT 10"),
    ("WITH x AS (SELECT 1) SELECT * FROM x", "WITH x AS (SELECT 1) SELECT * FROM x"),
    ("```sql\nSELECT 1\n```;", "SELECT 1"),
    ("```\nSELECT 1\n```", "SELECT 1"),
    ("SELECT created_at, updated_by FROM iceberg.gold.fact_sales",
     "SELECT created_at, updated_by FROM iceberg.gold.fact_sales"),
    ("SELECT * FROM iceberg.gold.fact_sales -- DROP TABLE later\nLIMIT 5",
     "SELECT * FROM iceberg.gold.fact_sales -- DROP TABLE later\nLIMIT 5"),
    ("```sql\nSELECT 1;\n```", "SELECT 1"),
    ("  SELECT 1 ;  ", "SELECT 1"),
    ("SELECT éUPDATE FROM t", "SELECT éUPDATE FROM t"),           # accented letter joins the word
]
REJECT = [
    ("DROP TABLE iceberg.gold.fact_sales", "not_select", None),
    ("DELETE FROM iceberg.gold.fact_sales", "not_select", None),
    ("INSERT INTO iceberg.gold.fact_sales VALUES (1)", "not_select", None),
    ("UPDATE iceberg.gold.fact_sales SET quantity = 0", "not_select", None),
    ("CREATE TABLE evil AS SELECT * FROM iceberg.gold.fact_sales", "not_select", None),
    ("TRUNCATE TABLE iceberg.gold.fact_sales", "not_select", None),
    ("ALTER TABLE iceberg.gold.fact_sales DROP COLUMN quantity", "not_select", None),
    ("MERGE INTO iceberg.gold.fact_sales USING x ON true WHEN MATCHED THEN DELETE", "not_select", None),
    ("GRANT SELECT ON iceberg.gold.fact_sales TO bob", "not_select", None),
    ("CALL some_procedure()", "not_select", None),
    ("SELECT 1; DROP TABLE iceberg.gold.fact_sales", "multiple", None),
    ("EXPLAIN SELECT * FROM iceberg.gold.fact_sales", "not_select", None),
    ("", "empty", None),
    ("   ", "empty", None),
    (None, "empty", None),
    ("SELECT REPLACE(name, 'a', 'b') FROM t", "forbidden", "REPLACE"),    # kept false positive
    ("SELECT comment FROM t", "forbidden", "COMMENT"),                    # kept false positive
    ("SELECT 'a;b' FROM t", "multiple", None),                            # ';' in a literal
    ("WITH d AS (DELETE FROM t RETURNING *) SELECT * FROM d", "forbidden", "DELETE"),
    ("SELECT 1 /* DROP */ FROM t", "ok", None),
]


@pytest.fixture(scope="module")
def screened(spark):
    rows = [(i, t) for i, (t, _) in enumerate(OK)] + [(100 + i, t) for i, (t, _, _) in enumerate(REJECT)]
    df = spark.createDataFrame(rows, "id int, text string")
    return {r.id: r for r in R.screen(df).collect()}, rows


def test_accepted_statements_are_cleaned(screened):
    res, _ = screened
    for i, (_, cleaned) in enumerate(OK):
        assert res[i].verdict == "ok", OK[i]
        assert res[i].cleaned == cleaned


def test_rejected_statements(screened):
    res, _ = screened
    for i, (text, verdict, kw) in enumerate(REJECT):
        r = res[100 + i]
        assert r.verdict == verdict, text
        assert r.keyword == kw, text
        assert r.cleaned is None or verdict == "ok"


def test_duckdb_form_agrees(screened):
    res, rows = screened
    con = duckdb.connect()
    con.execute("CREATE TABLE cases(id INTEGER, text VARCHAR)")
    con.executemany("INSERT INTO cases VALUES (?, ?)", rows)
    q = oracle.screening_sql("cases", "text", ["id"], R.FORBIDDEN_KEYWORDS, R.FENCE, R.BLOCK_COMMENT,
                             R.LINE_COMMENT)
    for i, verdict, kw, cleaned, first in con.execute(q).fetchall():
        r = res[i]
        assert (r.verdict, r.keyword, r.cleaned, r.first_forbidden) == (verdict, kw, cleaned, first), i


def test_registered_input_reaches_every_verdict(spark, sf_small):
    from mercato.queries import QUERIES
    got = {r.verdict for r in QUERIES["screen_sql_log"](spark, sf_small).select("verdict").distinct().collect()}
    assert got == {"empty", "multiple", "not_select", "forbidden", "ok"}


def test_unicode_blanks(spark):
    df = spark.createDataFrame([(" SELECT 1",), ("  ",), ("\x85with t as (select 1) select 1",)], "text string")
    assert [r.verdict for r in R.screen(df).collect()] == ["ok", "empty", "ok"]
