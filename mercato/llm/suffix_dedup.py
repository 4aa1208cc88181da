"""Exact substring dedup with a distributed, prefix-aware suffix merge sort.

Every byte covered by a WIDTH-byte string that starts anywhere else too is
removed.  Sorting all suffixes of the corpus would move each byte hundreds of
times, so the suffix array is sparse: windows choose a position by their own
bytes (`sampling.runs`), equal windows choose the same place, and only chosen
positions whose gram occurs at least twice enter the sort.

1. Sampling: per text its chosen positions and gram hashes.
2. Grams seen twice or more (partial counts).  The most frequent ones, at most
   HOT_GRAMS, keep their places by a broadcast, the others by a join.
3. Each task sorts the suffixes of its candidates: a key is the text from the
   chosen position to the end of its last window, then the bytes before it
   reversed, so one key holds a run of windows whole.  Equal keys of a task
   become one entry.  The runs are cut at splitters taken from a sample of keys
   and travel front-coded.
4. Each range merges its runs with a loser tree that never re-compares known
   prefixes.  Equal neighbours are repeats.  Keys that share a gram but differ
   are the ends of repeated passages: their windows are compared one by one
   inside the gram's group.  A group cut by a range border hands one row per
   distinct open window to a last exchange, where ranges meet.
5. Spans meet the texts; the removed bytes are the union of repeated windows.

No key, however frequent, fills a task: a task sends one entry per distinct key,
and a gram's group is split by the splitters inside the gram.

Defined results: null is empty; texts under WIDTH bytes keep everything; rows
repeated in id and text repeat each other (all windows go); invalid UTF-8 left
by a cut is dropped where text is returned; extra columns pass through.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sampling, suffix_sort, tokens
from .common import cut, prepare
from .ranks import ranked, stored

WIDTH, GRAM = sampling.WIDTH, sampling.GRAM
RUN_BYTES = 48 << 20          # key bytes a task holds before it closes a run
SPLITTER_KEYS = 40            # sampled keys per range
HOT_GRAMS = 10_000            # grams that are broadcast, at most

_MERGED = "k1 long, k2 long, first long, last long, open binary"


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: row keys, gram hashes, packed places (position << 16 | before << 8 | windows - 1)."""
    for batch in batches:
        for a, b, data, off in tokens.pieces(batch.column(2)):
            doc, at, p1, p2, h = sampling.runs(data, off)
            place = (at << 16) | ((at - p1) << 8) | (p2 - p1)
            bounds = pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                pa.ListArray.from_arrays(bounds, pa.array(h.view(np.int64))),
                pa.ListArray.from_arrays(bounds, pa.array(place)),
            ], ["k1", "k2", "grams", "places"])


def _key(text: bytes, place: int) -> tuple[bytes, int]:
    """(suffix from the chosen position + reversed bytes before it, length of the first part)."""
    at = place >> 16
    first = at - ((place >> 8) & 255)
    end = first + (place & 255) + WIDTH
    return text[at:end] + text[first:at][::-1], end - at


def _sample_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in tokens.pieces(batch.column(0)):
            doc, at, p1, p2, _ = sampling.runs(data, off)
            raw = data.tobytes()
            place = ((at << 16) | ((at - p1) << 8) | (p2 - p1)).tolist()
            ends = off.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(
                [_key(raw[ends[d]:ends[d + 1]], p)[0] for d, p in zip(doc.tolist()[::5], place[::5])], pa.binary())], ["key"])


def _splitters(docs: DataFrame, ranges: int, positions: int, rows: int) -> list[bytes]:
    """ranges - 1 keys that cut the sorted suffixes about evenly, from a seeded
    sample of texts; they decide where a suffix is sorted, never the result.  The
    sample is sorted and ranked in Spark: only the cutting keys come to the driver."""
    want = SPLITTER_KEYS * ranges
    share = min(1.0, 10.0 * want / max(positions, 1) + 40.0 / max(rows, 1))
    keys = stored(docs.select("text").sample(fraction=share, seed=7).mapInArrow(_sample_keys, "key binary")
                  .withColumn("tie", F.monotonically_increasing_id()), "suffix-keys")        # equal keys spread over tasks
    part = lambda r: F.floor(r * ranges / F.col("size"))
    cuts = ranked(keys, ["key", "tie"], name="suffix-ranks").filter((F.col("rank") > 0) & (part(F.col("rank")) > part(F.col("rank") - 1)))
    return sorted(bytes(r.key) for r in cuts.select("key").collect())


def _close_run(entries: dict, splitters: list[bytes], done: list, repeats: list) -> None:
    """Sort one run, cut it at the splitters, front-code the parts; postings of
    keys the run holds twice are settled here."""
    flat = []
    for (key, right), posts in entries.items():
        if len(posts) > 1:
            repeats.extend(posts)
        flat.append((key, right, len(posts) > 1, *posts[0]))
    flat.sort()
    at = 0
    while at < len(flat):
        rng = bisect.bisect_right(splitters, flat[at][0])
        end = len(flat) if rng == len(splitters) else bisect.bisect_left(flat, (splitters[rng],), at)
        done.append((rng, suffix_sort.encode(flat[at:end])))
        at = end
    entries.clear()


def _spans(posts: list) -> list[tuple[int, int, int, int]]:
    """Adjacent window runs of one text joined: (k1, k2, first window, last window)."""
    out: list = []
    for k1, k2, place in sorted(posts):
        first = (place >> 16) - ((place >> 8) & 255)
        last = first + (place & 255)
        if out and out[-1][:2] == [k1, k2] and first <= out[-1][3] + 1:
            out[-1][3] = max(out[-1][3], last)
        else:
            out.append([k1, k2, first, last])
    return out


def _sorted_runs(splitters: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, size, done, repeats = {}, 0, [], []

        def flush():
            if entries:
                _close_run(entries, splitters, done, repeats)
            spans = _spans(repeats)
            n, m = len(done), len(spans)
            cols = list(zip(*spans)) if m else [(), (), (), ()]
            batch = pa.RecordBatch.from_arrays([
                pa.array([d[0] for d in done] + [int(k) % (len(splitters) + 1) for k in cols[1]], pa.int32()),
                *[pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(c, pa.int64())]) for c in cols],
                pa.concat_arrays([pa.array([d[1] for d in done], pa.binary()), pa.nulls(m, pa.binary())])],
                ["rng", "k1", "k2", "first", "last", "block"])
            done.clear()
            repeats.clear()
            return batch

        for batch in batches:
            row = batch.column(2)
            texts = row.field("text").cast(pa.binary()) if isinstance(row, pa.StructArray) else row.cast(pa.binary())
            for i in range(batch.num_rows):
                k1, k2, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), texts[i].as_py()
                for place in batch.column(3)[i].values.to_numpy().tolist():
                    key = _key(text, place)
                    posts = entries.get(key)
                    if posts is None:
                        entries[key] = [(k1, k2, place)]
                        size += len(key[0])
                    else:
                        posts.append((k1, k2, place))
                        size += 24
                if size > RUN_BYTES:
                    size = 0
                    yield flush()
        yield flush()
    return run


class _Group:
    """Distinct keys that share a gram, in order."""

    def __init__(self):
        self.items = []           # [key, right length, postings, settled, prefix shared with the item before]

    def resolve(self, whole: bool, emit, hand_on) -> None:
        """Find repeated windows among the keys.  `whole`: the group lies inside
        the range; otherwise windows still open are handed on."""
        items = self.items
        if len(items) < 2 and whole:
            return
        specs = []
        for i, (key, right, posts, settled, _) in enumerate(items):
            place = posts[0][2]
            before, windows = (place >> 8) & 255, place & 255
            reach = max(items[i][4], items[i + 1][4] if i + 1 < len(items) else 0)
            low = before - windows if not whole else max(before - windows, WIDTH - min(reach, right))
            if low <= before:
                specs.append((low, before, key[right:][::-1] + key[:right], i))
        found: dict[int, list] = {}
        for d in range(min((s[0] for s in specs), default=0), max((s[1] for s in specs), default=-1) + 1):
            seen: dict[bytes, list] = {}              # one offset at a time: memory follows the keys
            for low, before, text, i in specs:
                if low <= d <= before:
                    seen.setdefault(text[before - d:before - d + WIDTH], []).append(i)
            for w, owners in seen.items():
                again = len(owners) > 1 or items[owners[0]][3]
                if again:
                    for i in owners:
                        if not items[i][3]:
                            found.setdefault(i, []).append(d)
                if not whole:
                    k1, k2, place = items[owners[0]][2][0]
                    hand_on(w, None if again else (k1, k2, (place >> 16) - d))
        for i, ds in found.items():
            k1, k2, place = items[i][2][0]
            ds.sort()
            start = 0
            for j in range(1, len(ds) + 1):
                if j == len(ds) or ds[j] != ds[j - 1] + 1:
                    emit(k1, k2, (place >> 16) - ds[j - 1], (place >> 16) - ds[start])
                    start = j


def _merge_range(blocks: list[bytes], yield_rows) -> Iterator[pa.RecordBatch]:
    rows: list = []

    def emit(k1, k2, first, last):
        rows.append((k1, k2, first, last, None))

    def hand_on(window, owner):
        digest = hashlib.blake2b(window, digest_size=16).digest()
        k1, k2, p = owner or (None, None, None)
        rows.append((k1, k2, p, p, digest))

    group, n_groups = _Group(), 0
    last_key, last_right = None, -1

    def settle(item):
        if item[3]:
            for k1, k2, place in item[2]:
                first = (place >> 16) - ((place >> 8) & 255)
                emit(k1, k2, first, first + (place & 255))

    for shared, key, right, many, k1, k2, place in suffix_sort.merge([suffix_sort.decode(b) for b in blocks]):
        if last_key is not None and right == last_right and shared == len(key) == len(last_key):
            item = group.items[-1]
            if not many:
                item[2].append((k1, k2, place))
            item[3] = True
            continue
        if group.items and shared < GRAM:
            for item in group.items:
                settle(item)
            group.resolve(n_groups > 0, emit, hand_on)
            n_groups += 1
            group = _Group()
            if len(rows) > 50_000:
                yield yield_rows(rows)
                rows.clear()
        # a posting of a key that its run holds twice is settled there; it stays as the key's specimen
        group.items.append([key, right, [(k1, k2, place)], bool(many), shared])
        last_key, last_right = key, right
    for item in group.items:
        settle(item)
    group.resolve(False, emit, hand_on)
    yield yield_rows(rows)


def _rows(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.binary())],
                                      ["k1", "k2", "first", "last", "open"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, list[bytes]] = {}
    for batch in batches:
        block = batch.column(5)
        for i in np.flatnonzero(block.is_valid().to_numpy(zero_copy_only=False)).tolist():
            blocks.setdefault(batch.column(0)[i].as_py(), []).append(block[i].as_py())
        settled = batch.filter(block.is_null())
        if settled.num_rows:
            yield pa.RecordBatch.from_arrays([settled.column(i) for i in (1, 2, 3, 4)]
                                             + [pa.nulls(settled.num_rows, pa.binary())],
                                             ["k1", "k2", "first", "last", "open"])
    for rng in sorted(blocks):
        yield from _merge_range(blocks.pop(rng), _rows)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows as one struct with the row key (k1, k2): equal keys have equal texts."""
    kind = docs.schema["doc_id"].dataType
    k1 = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) if isinstance(kind, T.IntegralType) else F.xxhash64("doc_id")
    return docs.select(k1.alias("k1"), F.xxhash64("text").alias("k2"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keyed rows, spans): spans has per row key the runs [first, last] of
    window starts that occur anywhere else too."""
    spark = docs.sparkSession
    prepare(spark)
    keyed = _keyed(docs)
    chosen = cut(keyed.select("k1", "k2", F.col("row.text").alias("text")).filter(F.octet_length("text") >= WIDTH)
                 .mapInArrow(_chosen, "k1 long, k2 long, grams array<long>, places array<long>"))
    rows, positions = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitters = _splitters(docs, ranges, positions, rows)

    again = cut(chosen.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    # as the counts add up to the positions, HOT_GRAMS grams at most are hot: broadcast, whatever the
    # input, so that no key of the other join holds more than positions / HOT_GRAMS rows
    often = F.col("n") > positions / HOT_GRAMS
    hot = again.filter(often).select("gram", F.lit(True).alias("hot"))
    places = (chosen.select("k1", "k2", F.inline(F.arrays_zip(F.col("grams").alias("gram"), F.col("places").alias("place"))))
              .join(F.broadcast(hot), "gram", "left"))
    rest = places.filter("hot is null").join(again.filter(~often), "gram", "left_semi")
    candidates = (places.filter("hot").select("k1", "k2", "place").union(rest.select("k1", "k2", "place"))
                  .groupBy("k1", "k2").agg(F.collect_set("place").alias("places")))
    sent = (keyed.join(candidates, ["k1", "k2"]).select("k1", "k2", "row", "places")
            .mapInArrow(_sorted_runs(splitters), "rng int, k1 long, k2 long, first long, last long, block binary"))
    merged = sent.repartition(ranges, "rng").mapInArrow(_merged, _MERGED)
    # open windows of groups that a range border cut meet here; each range sends a distinct window once
    alone = F.when(F.col("open").isNull(), F.xxhash64("k1", "k2", "first"))
    merged = (merged.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("open", alone)))
              .filter("k2 is not null and (open is null or n > 1)"))
    spans = merged.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return keyed, spans


def _cuts(text: bytes, spans) -> list[tuple[int, int]]:
    """Maximal removed byte runs."""
    out: list = []
    for s in sorted((s["first"], s["last"] + WIDTH) for s in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, spans = batch.column(0), batch.column(1)
        texts = row.field("text").cast(pa.binary())
        n, removed, runs, sha, kept, whole = [], [], [], [], [], []
        for i in range(batch.num_rows):
            text = texts[i].as_py() or b""
            cuts = _cuts(text, spans[i].as_py())
            left, at = [], 0
            for a, b in cuts:
                left.append(text[at:a])
                at = b
            left = b"".join(left) + text[at:] if cuts else text
            n.append(len(text))
            removed.append(len(text) - len(left))
            runs.append(len(cuts))
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
            ends = [0, *(x for c in cuts for x in c), len(text)]
            whole.append("".join(text[a:b].decode("utf-8", "ignore") for a, b in zip(ends[::2], ends[1::2])) if cuts else None)
        yield pa.RecordBatch.from_arrays([row, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                                          pa.array(sha, pa.string()), pa.array(kept, pa.binary()), pa.array(whole, pa.string())],
                                         ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"])


def dedup(docs: DataFrame) -> DataFrame:
    """row (struct of the document's columns), n_bytes, n_removed, n_spans,
    kept_sha256, kept (the remaining bytes) and kept_text (of a cut text, what is
    left without the characters that a cut broke)."""
    keyed, spans = repeated_windows(docs)
    schema = T.StructType([keyed.schema["row"]] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
                          + [T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType()),
                             T.StructField("kept_text", T.StringType())])
    return keyed.join(spans, ["k1", "k2"], "left").select("row", "spans").mapInArrow(_kept, schema)


def cut_texts(docs: DataFrame) -> DataFrame:
    """`docs` with repeated passages cut from `text`; documents of which nothing
    is left go.  A character that a cut left incomplete is dropped with it."""
    d = dedup(docs).filter("n_removed = 0 or n_removed < n_bytes")
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept_text"))
    return d.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    return dedup(docs.select("doc_id", "text")).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
