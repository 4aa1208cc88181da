"""R-01: screening of SQL text as a Spark job over a column of statements.

For each statement: remove markdown code fences and trailing ';', drop
comments for the checks, then give a verdict, in this order:
  empty       — NULL or blank
  multiple    — a ';' remains after cleaning (several statements)
  not_select  — does not start with SELECT or WITH
  forbidden   — contains a write/DDL keyword as a whole word (first in list order)
  ok          — `cleaned` is the statement to run (comments kept)
Everything is `regexp_replace` / `rlike` / `when` — JVM-side, no Python UDF.
Known, kept false positives: keywords or ';' inside string literals, the
REPLACE() function, a column named `comment`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values (screening rules) ---
FORBIDDEN_KEYWORDS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE",
    "MERGE", "GRANT", "REVOKE", "CALL", "COMMENT", "ATTACH", "DETACH",
    "COPY", "EXECUTE", "REPLACE", "VACUUM", "ANALYZE",
)
FENCE = r"(?im)^```(?:sql)?\s*|```$"
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
LINE_COMMENT = r"--[^\n]*"
# a word character is a Unicode letter, digit or '_'; boundaries are written
# out so every regex engine agrees on accented text
WORD = r"[\p{L}\p{N}_]"
# blanks include the Unicode separators, in the same notation for every regex engine
BLANK = r"[\s\x1c-\x1f\x{85}\p{Z}]"
LEADING_SELECT = rf"(?i)^{BLANK}*(SELECT|WITH)(?!{WORD})"
# --------------------------------------

_WS_EDGES = rf"^{BLANK}+|{BLANK}+$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, _WS_EDGES, "")


def clean_sql(raw: Column) -> Column:
    """fences removed, outer whitespace and trailing ';' stripped"""
    no_fence = _strip(F.regexp_replace(raw, FENCE, ""))
    return _strip(F.regexp_replace(no_fence, r";+$", ""))


def strip_comments(sql: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(sql, BLOCK_COMMENT, " "), LINE_COMMENT, " ")


def first_forbidden(sql: Column) -> Column:
    """first keyword of the list that occurs as a whole word (case-insensitive).

    One scan with the alternation of all keywords decides whether any is
    present; only then is the list walked in order (CASE evaluates lazily)."""
    any_kw = rf"(?i)(?<!{WORD})(?:{'|'.join(FORBIDDEN_KEYWORDS)})(?!{WORD})"
    in_order = F.coalesce(*[F.when(sql.rlike(rf"(?i)(?<!{WORD}){kw}(?!{WORD})"), F.lit(kw))
                            for kw in FORBIDDEN_KEYWORDS])
    return F.when(sql.rlike(any_kw), in_order)


def screen(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds verdict, keyword, cleaned (only when ok) and the diagnostic
    `first_forbidden` (keyword found anywhere, whatever the verdict).

    Two projections: the cleaned text and the keyword scan are computed once
    and referenced by name (Catalyst does not inline a non-trivial expression
    used twice)."""
    raw = F.col(text)
    step = df.select("*", clean_sql(raw).alias("_cleaned"), (raw.isNull() | (_strip(raw) == "")).alias("_empty"))
    step = step.select("*", strip_comments(F.col("_cleaned")).alias("_nocom"))
    step = step.select("*", first_forbidden(F.col("_nocom")).alias("first_forbidden"))
    verdict = (F.when(F.col("_empty"), "empty")
               .when(F.instr(F.col("_nocom"), ";") > 0, "multiple")
               .when(~_strip(F.col("_nocom")).rlike(LEADING_SELECT), "not_select")
               .when(F.col("first_forbidden").isNotNull(), "forbidden")
               .otherwise("ok"))
    step = step.select("*", verdict.alias("verdict"))
    return step.select(*df.columns, "verdict",
                       F.when(F.col("verdict") == "forbidden", F.col("first_forbidden")).alias("keyword"),
                       F.when(F.col("verdict") == "ok", F.col("_cleaned")).alias("cleaned"),
                       "first_forbidden")


class RejectedStatement(ValueError):
    def __init__(self, verdict: str, keyword: str | None):
        super().__init__(f"statement rejected: {verdict}" + (f" ({keyword})" if keyword else ""))
        self.verdict, self.keyword = verdict, keyword


def run_if_safe(spark, statement: str) -> DataFrame:
    """Screen one statement with the same rules and run the cleaned text with
    `spark.sql` only when the verdict is `ok` (read-only SELECT/WITH)."""
    row = screen(spark.createDataFrame([(statement,)], "text string")).first()
    if row.verdict != "ok":
        raise RejectedStatement(row.verdict, row.keyword)
    return spark.sql(row.cleaned)
