"""Null, empty, repeated, tied and clashing inputs, one small table for all operators."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from mercato.llm import (decontaminate, fingerprint, language_id, license_scan, mixing, near_dedup, passages, suffix_dedup,
                         toxicity, warc)

LONG = " ".join(f"word{i} and so on." for i in range(4000))
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "One.", None, None), (3, "One.", None, None),
    (4, LONG, "de", "b"), (5, LONG, "de", "b"), (None, "no id here at all, none", "en", "b"),
    (6, "ünïcödé 漢字 " * 30, "fr", "c"), (7, "x" * 700, None, "c"), (8, "\n\n  \t", "en", ""),
    (9, "Licensed under the Apache License, Version 2.0.", "en", "a"),
]
CLASH = ("score", "kept", "n", "t", "c", "e", "q", "n_docs", "block", "slot", "rep", "band", "k1", "row", "spans", "words", "seed")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(7) for c in CLASH}).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (4, 1), (5, 1), (2, 0), (None, 1), (6, None)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one"), (2, None), (3, ""), (4, "word7 and so on word8 and so on word9 and so on word10")],
                                 "item_id long, text string")


def test_row_reports_cover_every_row(spark, docs, none, labels, benchmark):
    runs = {
        "license": lambda d: license_scan.report(d), "language": lambda d: language_id.report(d),
        "toxicity": lambda d: toxicity.report(d, labels), "fingerprint": lambda d: fingerprint.report(d),
        "near": lambda d: near_dedup.report(d), "suffix": lambda d: suffix_dedup.report(d),
        "contamination": lambda d: decontaminate.report(d, benchmark)}
    for name, run in runs.items():
        got = run(docs).collect()
        assert len(got) == len(ROWS), name
        assert sorted(r.doc_id or 0 for r in got) == sorted(r[0] or 0 for r in ROWS), name
        assert run(none).count() == 0, name


def test_defined_results(docs, labels, benchmark):
    near = {r.doc_id: r for r in near_dedup.report(docs).collect()}
    assert near[5].component_id == 4 and not near[5].kept and near[4].kept
    assert near[1].n_shingles == 0 and near[1].component_id == 1 and near[3].n_shingles == 1
    assert near[None].component_id is None and near[None].kept
    lang = {r.doc_id: r for r in language_id.report(docs).collect()}
    assert lang[1].lang_pred == lang[8].lang_pred == "und" and lang[1].score == 0
    suffix = {r.doc_id: r for r in suffix_dedup.report(docs).collect()}
    assert suffix[4].n_removed == suffix[4].n_bytes == len(LONG) and suffix[7].n_removed == 700 and suffix[9].n_removed == 0
    assert suffix[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    con = {r.doc_id: r for r in decontaminate.report(docs, benchmark).collect()}
    assert con[3].n_hit == 1 and con[3].contaminated and con[1].n_words == 0 and not con[1].contaminated
    assert con[4].n_items == 1 and con[4].n_hit == 13 and not con[4].contaminated
    tox = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    assert tox[1].score == 0 and tox[2].score == 0 and not tox[None].held_out
    lic = {r.doc_id: r for r in license_scan.report(docs).collect()}
    assert lic[9].licenses == "Apache-2.0" and lic[2].licenses == ""


def test_passing_through_keeps_columns(docs, none, labels, benchmark):
    stages = [lambda d: toxicity.keep_clean(d, labels), near_dedup.keep_one, suffix_dedup.cut_texts,
              lambda d: decontaminate.remove_documents(d, benchmark), lambda d: decontaminate.remove_spans(d, benchmark)]
    for stage in stages:
        out = stage(docs)
        assert out.columns == docs.columns
        assert all(r[c] == 7 for r in out.collect() for c in CLASH)
        assert stage(none).count() == 0
    mixed = mixing.mix(docs, epochs="once")
    assert mixed.columns == [*docs.columns, "mix"] and mixed.count() == len(ROWS)
    assert mixing.mix(none).count() == 0


def test_remove_spans_cuts_only_hits(spark, benchmark):
    d = spark.createDataFrame([(1, "Zero! One, two.")], "doc_id long, text string")
    assert decontaminate.remove_spans(d, benchmark).first().text == "Zero! two."


def test_cut_texts_drops_broken_characters(spark):
    same = "é" * 120                                        # 240 bytes, repeated
    rows = [(1, "A" + same + "left"), (2, "B" + same)]
    out = {r.doc_id: r.text for r in suffix_dedup.cut_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "Aleft", 2: "B"}


def test_passages_edges(docs, none):
    got = passages.find(docs).collect()
    assert [(r.doc_id, r.other_id) for r in got] == [(5, 4)] and got[0].n_equal == len(re.findall(r"\w+", LONG))
    assert passages.find(none).count() == 0


def test_two_classes_missing_gives_a_silent_model(docs, spark):
    one = spark.createDataFrame([(4, 1)], "doc_id long, toxic int")
    assert all(r.score < 0.01 for r in toxicity.report(docs, one).collect())


def test_warc_edges(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "u", "q" * 1500), (2, "u", "q" * 1500), (2, "u", "q" * 1500), (3, None, None), (4, "a\r\nb", fake * 5),
            (5, "u", "WARC/1.0\r\n" * 9 + "x" * 1000), (6, "u", "short"), (7, "u", "short"), (None, "u", "q" * 1500), (8, "", "\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit(1))
    want = sorted((i or 0, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(),
                   "revisit" if (h or "") == "q" * 1500 and i != 2 else "response",
                   2 if (h or "") == "q" * 1500 and i != 2 else 0) for i, _, h in rows)
    got = warc.report(spark, pages).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in got) == want
    assert warc.report(spark, pages.limit(0)).count() == 0
