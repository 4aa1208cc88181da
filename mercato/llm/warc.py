"""WARC writing and reading, with boundary-chain verification.

Writing: one record per page; each archive is a text file that Spark writes, so
any file system Spark knows will do.  Records with equal payloads of at least
1000 bytes are stored once: the page with the largest id is the response, the
others are revisit records that name it.

Reading: the archives are split like any text, at the line "WARC/1.0".  A
piece's offset (in uncompressed bytes) follows from the sizes of the pieces
before it: tasks count from their split's start, and a running total over a
file's splits, one row each, gives the starts.  Every piece is a candidate: its Content-Length states its
successor's offset.  The magic line may also stand inside a payload, and such a
piece may look like a record; so a task emits, for each candidate, where its
chain leaves the split, and pointer jumping from offset 0 of each file finds
where the true chain enters every split: in each round the reached set doubles
and the pointers are squared, so the rounds grow with the logarithm of a file's
splits.  Only reachable candidates are records; pieces between them are given
back to the payload they came from, across splits too.

Defined results: null html is an empty payload; short payloads are always
responses; pages repeated in id and payload are all responses when theirs is
the largest id; a null page_id writes no id and reads back null; null urls are
empty; line breaks in urls are percent-encoded; an empty table writes and reads
no records; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, prepare, scratch

MAGIC = "WARC/1.0\r\n"
BREAK = "\r\n"
LEAST_REVISIT = 1000       # bytes a payload must have to be stored once
BROADCAST_ROWS = 200_000   # rows of ids and digests, or of splits, that may be broadcast, about 20 MB
CONTENT_LENGTH = re.compile(rb"(?:^|\r\n)Content-Length: (\d{1,15})(?:\r\n|$)")
STAMP = "2024-01-01T00:00:00Z"      # archives carry no wall clock, so writing twice gives equal files
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to."""
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1("html")})
    # counted first, so that a payload with many copies is one row per task
    top = cut(p.filter(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest", "payload_bytes")
              .agg(F.max("page_id").alias("_top"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    p = p.join(_small(top), ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("_top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_top"))
    return p.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"),
                          "refers_to": F.when(revisit, F.col("_top"))}).drop("_top")


def _small(df: DataFrame) -> DataFrame:
    """`df`, marked for broadcast when its counted rows are few; else the join
    shuffles and AQE splits hot keys."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _record(p: DataFrame) -> DataFrame:
    """The bytes of each record without the final blank lines."""
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    body = F.concat(F.lit(HTTP), F.col("payload_bytes").cast("string"), F.lit(BREAK * 2), F.col("html"))
    response = F.col("record_type") == "response"
    kind = F.when(response, "application/http; msgtype=response").otherwise("application/octet-stream")
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.col("record_type"),
        F.lit(BREAK + "WARC-Record-ID: "), urn(F.col("page_id")),
        F.lit(BREAK + "WARC-Date: " + STAMP + BREAK + "WARC-Target-URI: "), url,
        F.lit(BREAK + "WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit(BREAK + "X-Payload-Bytes: "), F.col("payload_bytes").cast("string"),
        F.when(response, "").otherwise(F.concat(F.lit(BREAK + "WARC-Refers-To: "), urn(F.col("refers_to")))),
        F.lit(BREAK + "Content-Type: "), kind,
        F.lit(BREAK + "Content-Length: "), F.when(response, F.octet_length(body)).otherwise(0).cast("string"),
        F.lit(BREAK * 2))
    return p.select(F.concat(head, F.when(response, body).otherwise("")).alias("value"))


def write(pages: DataFrame, path: str, records_per_file: int = 1_000_000, compression: str = "none") -> None:
    """Write the archives; a file holds one task's records, `records_per_file` at
    most.  Uncompressed archives are split when read; a gzip file is one split."""
    (_record(plan_records(pages)).write.option("lineSep", BREAK * 2).option("compression", compression)
     .option("maxRecordsPerFile", records_per_file).text(path))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of the archives and `place`, which grows along a split."""
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                    F.col("value").alias("piece"), F.monotonically_increasing_id().alias("place")))


def _beside(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """`lines` with the columns of `splits` (one row per split), a split's pieces in
    their order.  Few splits, counted, are broadcast; beyond that the pieces are
    shuffled by split and sorted."""
    if splits.count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(splits), ["file", "split"])
    return lines.join(splits.hint("merge"), ["file", "split"]).sortWithinPartitions("file", "split", "place")


def _walk(batches: Iterator[pa.RecordBatch], running: dict) -> Iterator[tuple]:
    """(batch, row, (file, split), offset, successor's offset or None, bytes needed, piece) of a
    split's pieces, which come in their order.  The first columns are file, split, start, piece."""
    for batch in batches:
        files, splits, starts = (batch.column(i).to_pylist() for i in (0, 1, 2))
        for i, piece in enumerate(batch.column(3).cast(pa.binary())):
            body, key = piece.as_py(), (files[i], splits[i])
            first = key not in running
            here = starts[i] if first else running[key]
            running[key] = here + len(body) + len(MAGIC)
            if first and not key[1]:
                continue                             # a file starts with the magic line: its first, empty piece is no candidate
            end = body.find(b"\r\n\r\n")
            length = CONTENT_LENGTH.search(body[:end]) if end >= 0 else None
            need = end + 4 + int(length[1]) if length else None
            yield batch, i, key, here - len(MAGIC), None if need is None else here + need + 4, need, body


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per candidate where its chain leaves the split, and per split (`at` null) its
    size: offsets from the split's start only, no payloads."""
    sizes: dict[tuple, int] = {}

    def edges(key, rows):
        out: dict[int, int | None] = {}
        for at, after in reversed(rows):             # a successor lies further on, so it is known already
            out[at] = out.get(after, after)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(out), pa.string()), pa.array([key[1]] * len(out), pa.int64()),
                                           pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int64())],
                                          ["file", "split", "at", "exit"])

    last, rows = None, []
    for _, _, key, at, after, _, _ in _walk(batches, sizes):
        if key != last and rows:
            yield edges(last, rows)
            rows = []
        last = key
        rows.append((at, after))
    if rows:
        yield edges(last, rows)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sizes], pa.string()), pa.array([k[1] for k in sizes], pa.int64()),
                                      pa.nulls(len(sizes), pa.int64()), pa.array(list(sizes.values()), pa.int64())],
                                     ["file", "split", "at", "exit"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow the chain from a split's entry.  A record that its split holds whole
    comes out whole; else its pieces come out under the split that owns it."""
    state: dict[tuple, list] = {}                    # split -> [expected offset, offset, needed bytes, parts, size]
    rows: list = []

    def close(key, s):
        if s[3]:
            rows.append((key[0], key[1], s[1], MAGIC.encode().join(s[3]), s[4] >= s[2]))
        s[3], s[4] = [], 0

    def flush():
        cols = list(zip(*rows)) if rows else [()] * 5
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                           pa.array(cols[3], pa.binary()).cast(pa.string()), pa.array(cols[4], pa.bool_())],
                                          ["file", "owner", "at", "piece", "whole"])

    for batch, i, key, at, after, need, body in _walk(batches, {}):
        s = state.get(key)
        if s is None:
            s = state[key] = [batch.column(4)[i].as_py(), 0, 0, [], 0]
        if at == s[0] and after is not None:
            close(key, s)
            s[0], s[1], s[2], s[3], s[4] = after, at, need, [body], len(body)
        elif s[3]:
            if s[4] < s[2]:                          # inside the payload; what follows a broken chain is no record's
                s[3].append(body)
                s[4] += len(MAGIC) + len(body)
        else:
            owner = batch.column(5)[i].as_py()       # before the split's entry: an earlier split's last record
            if owner is not None:
                rows.append((key[0], owner, at, body, False))
        if len(rows) >= 256:
            yield flush()
    for key, s in state.items():
        close(key, s)
    yield flush()


def reachable(edges: DataFrame) -> DataFrame:
    """(file, at) where the chain from offset 0 enters a split, by pointer jumping:
    each round follows the pointers once and squares them.  An archive that is one
    split needs no round."""
    reached = edges.filter("at = 0").select("file", "at")
    # only pointers that end at a candidate go on
    step = cut(edges.join(edges.select("file", F.col("at").alias("exit")), ["file", "exit"]).select("file", "at", F.col("exit").alias("next")))
    while not step.isEmpty():
        reached = cut(reached.union(reached.join(step, ["file", "at"]).select("file", F.col("next").alias("at"))))
        step = cut(step.join(step.select("file", F.col("at").alias("next"), F.col("next").alias("then")), ["file", "next"])
                   .select("file", "at", F.col("then").alias("next")))
    return reached


def _splits(lines: DataFrame) -> DataFrame:
    """One row per split: start, entry (offset of the first record that starts in
    it), owner (the split of the record that its first pieces belong to) and
    ragged: a record begins in it and ends in another, or the reverse."""
    local = cut(lines.select("file", "split", F.lit(0).cast("long").alias("start"), "piece")
                .mapInArrow(_exits, "file string, split long, at long, exit long"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(local.filter("at is null").select("file", "split", F.col("exit").alias("total"))
                 .withColumn("start", F.coalesce(F.sum("total").over(before), F.lit(0))))
    edges = cut(local.filter("at is not null").join(starts, ["file", "split"])
                .select("file", "split", (F.col("at") + F.col("start")).alias("at"), (F.col("exit") + F.col("start")).alias("exit")))
    entries = edges.join(reachable(edges), ["file", "at"]).select("file", "split", F.col("at").alias("entry"), "exit")
    s = starts.join(entries, ["file", "split"], "left")
    s = s.withColumn("owner", F.last(F.when(F.col("entry").isNotNull(), F.col("split")), ignorenulls=True).over(before))
    late = (F.col("split") > 0) & (F.col("entry") != F.col("start") - len(MAGIC))
    open_end = ~F.col("exit").eqNullSafe(F.col("start") + F.col("total") - len(MAGIC))
    return cut(s.select("file", "split", "start", "entry", "owner", (F.col("entry").isNull() | late | open_end).alias("ragged")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records: file, at, header, block (the Content-Length bytes)."""
    prepare(spark)
    lines = _lines(spark, path)
    splits = _splits(lines)

    def parts(of: DataFrame) -> DataFrame:
        return (_beside(lines, of).select("file", "split", "start", "piece", "entry", "owner")
                .mapInArrow(_records, "file string, owner long, at long, piece string, whole boolean"))

    records = parts(splits).filter("whole").select("file", "at", "piece")
    ragged = splits.filter("ragged")
    if not ragged.isEmpty():                         # only these splits are read for pieces to put together
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), MAGIC)
        records = records.union(parts(ragged).filter("not whole").groupBy("file", "owner").agg(F.min("at").alias("at"), text.alias("piece"))
                                .select("file", "at", "piece"))
    head = F.substring_index("piece", BREAK * 2, 1)
    length = F.regexp_extract(head, r"(?:^|\r\n)Content-Length: (\d{1,15})(?:\r\n|$)", 1).cast("int")
    block = F.substring(F.col("piece").cast("binary"), F.octet_length(head) + 5, length)
    return records.select("file", "at", head.alias("header"), block.alias("block"))


def _field(name: str):
    return F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)


def pages_of(records: DataFrame) -> DataFrame:
    """What the records say about their pages; the digest of a stored payload is
    computed from its bytes, not taken from the header."""
    urn = lambda f: F.regexp_extract(_field(f), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    at = F.locate(BREAK * 2, F.decode("block", "ISO-8859-1"))
    payload = F.when(_field("WARC-Type") == "response", F.substring(F.col("block"), at + 4, F.length("block")))
    r = records.select(urn("WARC-Record-ID").alias("page_id"), _field("WARC-Target-URI").alias("url"),
                       _field("WARC-Type").alias("record_type"), urn("WARC-Refers-To").alias("refers_to"),
                       F.regexp_extract(_field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("stated"),
                       _field("X-Payload-Bytes").try_cast("long").alias("bytes"), payload.alias("payload"))
    return r.withColumns({"payload_bytes": F.coalesce(F.octet_length("payload").cast("long"), F.col("bytes")),
                          "payload_digest": F.coalesce(F.sha1("payload"), F.col("stated"))}).drop("bytes", "stated")


def report(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The contract's row per page, read back from archives in the shared folder."""
    path = scratch(spark, "warc")
    write(pages, path)
    return pages_of(read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
