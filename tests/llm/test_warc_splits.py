"""Archives that are read in many splits."""

import hashlib

import pytest

from mercato.llm import warc

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: {}\r\n\r\nabc\r\n\r\n"


@pytest.fixture()
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(kept, ("1500", "1")):
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.fixture()
def rounds(monkeypatch):
    """Grows by two with every round of pointer jumping, by one more for the first pointers."""
    seen, cut, inner = [], warc.cut, warc.reachable

    def jumps(edges):
        warc.cut = lambda df: seen.append(1) or cut(df)
        try:
            return inner(edges)
        finally:
            warc.cut = cut
    monkeypatch.setattr(warc, "reachable", jumps)
    return seen


@pytest.mark.parametrize("broadcast_rows", [warc.BROADCAST_ROWS, 0])
def test_fake_records_across_splits(spark, tmp_path, small_splits, rounds, monkeypatch, broadcast_rows):
    """Payloads longer than several splits hold lines and whole records that look real, with
    lengths that lead on, too far or nowhere; splits that are broadcast, and splits that are not."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast_rows)
    rows = [(1, "u", FAKE.format(3) * 60), (2, "u", "x" * 9000), (3, "u", "short"), (4, "u", FAKE.format(4000) * 40),
            (5, "u", "WARC/1.0\r\n" * 700), (6, "u", FAKE.format(10 ** 9) * 30 + "é" * 2000), (7, "u", ""),
            (8, "u", "x" * 9000), *((i, "u", f"p{i} " * (i % 400)) for i in range(20, 120))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = f"{tmp_path}/warc"
    warc.write(pages, path, compression="none")
    splits = warc._lines(spark, path).groupBy("file").agg({"split": "approx_count_distinct"}).collect()
    assert len(splits) == 1 and splits[0][1] > 20
    got = warc.pages_of(warc.read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert len(rounds) >= 1 + 2 * 3                         # a chain over more than 20 splits
    want = [(i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if i == 2 else "response", 8 if i == 2 else None)
            for i, _, h in rows]
    assert sorted(map(tuple, got)) == want


def test_the_query_jumps(spark, small_splits, rounds, sf_small):
    """The registered query's archives are read in many splits, and pointers jump."""
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    got = warc.report(spark, pages).select("page_id", "payload_bytes").collect()
    assert len(rounds) >= 1 + 2 * 3
    html = {r.page_id: r.html or "" for r in pages.collect()}
    assert sorted(map(tuple, got)) == sorted((i, len(h.encode())) for i, h in html.items())
