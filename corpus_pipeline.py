"""A training-corpus pipeline over `documents`: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and returns the documents it kept, with
the columns of `documents`; the last one adds the place in the mixture.  `run`
writes each stage's result as Parquet in the shared folder and reads it again
for the next, so a lost executor costs at most a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import decontaminate, mixing, near_dedup, suffix_dedup, toxicity
from mercato.llm.common import scratch, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic (noisy-or of their sentences at 0.5 or more) go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id."""
    return near_dedup.keep_one(docs)


def repeated_passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes inside repeated 200-byte strings are cut; emptied documents go."""
    out = suffix_dedup.cut_texts(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, with its place in the mixture of tempered source weights."""
    m = mixing.mix(docs, epochs="once", out="_mix")
    names = ("block", "block_row", "share", "period", "release", "deadline", "slot", "balanced")
    return m.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"_mix.{n}").alias(f"mix_{n}") for n in names])


STAGES = [
    ("toxicity", toxic_out),
    ("near_dedup", near_copies_out),
    ("suffix_dedup", repeated_passages_out),
    ("decontamination", benchmark_out),
    ("mixing", mixed),
]

#: A trained classifier decides the first stage, so no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
