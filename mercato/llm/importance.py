"""Importance resampling towards a target distribution.

Features are the runs of one to three words, hashed into buckets.  Comparing how
often each bucket occurs in the corpus and in the target gives every bucket a
gain; a document's weight is the sum of the gains of its features, scored
against one array of gains.  Perturbed by Gumbel noise from a hash of its id,
the highest scores are a draw without replacement in proportion to the weights.

The cutoff is found exactly and without a sort of all rows: every partition
tells the median of its remaining keys and their number; the median of these,
weighted by the numbers, has a guaranteed fraction of the keys on either side,
and one pass counts both sides (and tells both sides' medians for the next
round).  The side without the cutoff is discarded; survivors are stored again
when a quarter is left, so all rounds together read a small multiple of the
first.  The last FINISH keys are sorted as they are.  Only the winners are sorted.

Defined results: null text has no words, no features, weight 0; a null doc_id is
hashed as the empty string and ranks after others of its score; rows with equal
score and id rank in a stored order; an empty table draws nothing; extra columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import prepare
from .ranks import ranked, stored

BUCKETS = 10000
LENGTHS = 3                      # features are runs of 1 to LENGTHS words
LEAST_WORDS = 20                 # of a document that may be drawn
PERCENT = 5                      # of those are drawn
SEED = 42
FINISH = 256                     # so many remaining keys are sorted at once
WORDS = 1 << 19                  # words handled at once
SHORT = 48                       # bytes of a word hashed in step with other words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATES = np.zeros(256, bool)
_SEPARATES[:128] = True
_SEPARATES[48:58] = _SEPARATES[97:123] = False          # digits and letters, once lower-cased


def _crc_table() -> np.ndarray:
    """What a byte does to the CRC-32 register, from the reflected polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> 1) ^ np.where(c & 1, np.uint32(0xEDB88320), np.uint32(0))
    return c


_CRC = _crc_table()


def _step(register: np.ndarray, byte) -> np.ndarray:
    return _CRC[(register ^ byte) & 0xFF] ^ (register >> 8)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, first word per text plus the total)."""
    data = _LOWER[data]
    n = len(data)
    if not n:
        return data, *(np.zeros(0, np.int64),) * 2, np.zeros(len(off), np.int64)
    inside = ~_SEPARATES[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]      # words never cross texts
    start[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    ws = np.flatnonzero(start)
    return data, ws, np.flatnonzero(end) + 1, np.searchsorted(ws, off)


def _extend(crc: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of what `crc` stands for, followed by data[at:at + size]; sizes descend."""
    register = ~crc
    for k in range(min(int(size[0]), SHORT)):
        m = int(np.searchsorted(-size, -k))                  # words longer than k
        register[:m] = _step(register[:m], data[at[:m] + k])
    crc = ~register
    for i in range(int(np.searchsorted(-size, -SHORT))):
        crc[i] = zlib.crc32(data[at[i] + SHORT:at[i] + size[i]].data, int(crc[i]))
    return crc


def features(data: np.ndarray, ws: np.ndarray, we: np.ndarray) -> list[np.ndarray]:
    """Per length the CRC-32 of the run of words that ends at each word (joined by
    one space; meaningless where fewer words precede)."""
    order = np.argsort(-np.minimum(we - ws, 1 << 14).astype(np.int16), kind="stable")
    big = we[order] - ws[order]
    if len(big) and big[0] >= 1 << 14:                       # few, very long words: order them fully
        order = np.argsort(ws - we, kind="stable")
        big = we[order] - ws[order]
    at = ws[order]
    out = [np.zeros(len(ws), np.uint32)]
    for _ in range(LENGTHS):
        before = out[-1]
        if len(out) > 1:                                     # the shorter run that ends a word earlier, and a space
            before = ~_step(~np.concatenate([before[:1], before[:-1]]), np.uint8(32))
        crc = np.empty(len(ws), np.uint32)
        crc[order] = _extend(before[order], data, at, big) if len(ws) else before
        out.append(crc)
    return out[1:]


def _buckets(batch: pa.Array) -> Iterator[tuple[int, np.ndarray, list]]:
    """Per run of texts: index of the first, words per text, and chunks of
    (text of each feature, its bucket)."""
    for a, _, raw, off in tokens.pieces(batch):
        data, ws, we, first = words(raw, off)
        def chunks(data=data, ws=ws, we=we, first=first):
            for s in range(0, len(ws), WORDS):
                lead = min(s, LENGTHS - 1)                   # words before the chunk that its runs begin with
                e = min(len(ws), s + WORDS)
                text = np.searchsorted(first, np.arange(s, e), "right") - 1
                place = np.arange(s, e) - first[text]
                for length, crc in enumerate(features(data, ws[s - lead:e], we[s - lead:e])):
                    whole = place >= length
                    yield text[whole], (crc[lead:][whole] % BUCKETS).astype(np.int64)
        yield a, np.diff(first), chunks()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, chunks in _buckets(batch.column(0)):
            for _, bucket in chunks:
                total += np.bincount(bucket, minlength=BUCKETS)
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> dict[int, int]:
    """How many features of all texts fall into each bucket: at most BUCKETS numbers
    reach the driver, whatever the input."""
    prepare(texts.sparkSession)
    per = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts, "bucket long, n long")
    return {r.bucket: r.n for r in per.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """A bucket's log ratio in thousandths, counts raised by one."""
    s_all, t_all = float(sum(corpus.values()) + BUCKETS), float(sum(target.values()) + BUCKETS)
    return np.array([math.floor(1000 * math.log(((target.get(b, 0) + 1.0) * s_all) / ((corpus.get(b, 0) + 1.0) * t_all)))
                     for b in range(BUCKETS)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    prepare(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n_words, chunks in _buckets(batch.column(1)):
                n, weight = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
                for text, bucket in chunks:
                    n += np.bincount(text, minlength=len(n))
                    np.add.at(weight, text, gain[bucket])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(n)), pa.array(n_words), pa.array(n), pa.array(weight)],
                                                 ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", F.col("text").cast("string").alias("text"))
            .mapInArrow(score, f"doc_id {kind}, n_words long, n_features long, weight long"))


def perturbed(weight: Column, doc_id: Column, seed: int = SEED) -> Column:
    """The weight plus Gumbel noise (in thousandths) from a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


KEY = ("score", "doc_id", "row")                             # higher score, smaller id, earlier row first


def better(key: tuple) -> Column:
    """Rows before `key` in the drawing order."""
    score, doc_id, row = key
    same = F.col("doc_id").eqNullSafe(F.lit(doc_id))
    less = F.col("doc_id").isNotNull() if doc_id is None else F.coalesce(F.col("doc_id") < F.lit(doc_id), F.lit(False))
    return (F.col("score") > score) | ((F.col("score") == score) & (less | (same & (F.col("row") < row))))


def _is(key: tuple) -> Column:
    return F.col("row") == key[2]


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per side of the pivot the number of keys in this partition and their median."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    for side in pc.unique(t["side"]).to_pylist():
        part = t.filter(pc.equal(t["side"], side))
        at = pc.sort_indices(part, sort_keys=[("score", "descending"), ("doc_id", "ascending"), ("row", "ascending")], null_placement="at_end")
        one = part.take(at.slice(part.num_rows // 2, 1)).append_column("n", pa.array([part.num_rows], pa.int64()))
        yield from one.combine_chunks().to_batches()


def _order(row) -> tuple:
    return (-row["score"], row["doc_id"] is None, row["doc_id"] if row["doc_id"] is not None else 0, row["row"])


def cutoff(rows: DataFrame, k: int, finish: int = FINISH) -> tuple | None:
    """The k-th key (score, doc_id, row) of the drawing order, by weighted medians of
    the partitions' medians; None when there is none.

    The driver sees two keys per partition and round, and at last `finish` keys."""
    alive = rows.select(*KEY)
    kind = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in alive.schema)}, side int, n long"
    pivot, kept, n = None, None, None                        # kept: rows of the table behind `alive`
    while k > 0:
        side = F.lit(1) if pivot is None else F.when(better(pivot), 0).when(_is(pivot), 2).otherwise(1)
        told = alive.withColumn("side", side.cast("int")).mapInArrow(_medians, kind).collect()
        count = [sum(r["n"] for r in told if r["side"] == s) for s in range(3)]
        if pivot is None:
            n = kept = count[1]
            if k > n:
                return None
            pool = told
        elif k <= count[0]:
            alive, n, pool = alive.filter(better(pivot)), count[0], [r for r in told if r["side"] == 0]
        elif k == count[0] + count[2]:
            return pivot
        else:
            alive, n, k = alive.filter(~better(pivot) & ~_is(pivot)), count[1], k - count[0] - count[2]
            pool = [r for r in told if r["side"] == 1]
        if n <= finish:
            last = sorted(alive.collect(), key=_order)[k - 1]
            return tuple(last[c] for c in KEY)
        if 4 * n <= kept:
            alive, kept = stored(alive, "importance-keys"), n
        seen = 0
        for r in sorted(pool, key=_order):
            seen += r["n"]
            if 2 * seen >= n:
                pivot = tuple(r[c] for c in KEY)
                break
    return None


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
         finish: int = FINISH) -> DataFrame:
    """Every row's doc_id, n_words, n_features, weight, score and rank (1 is drawn
    first; null: not drawn)."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = weigh(docs, gain).withColumn("score", perturbed(F.col("weight"), F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "importance-scores")
    may = F.col("n_words") >= least_words
    key = cutoff(rows.filter(may), percent * rows.filter(may).count() // 100, finish)
    won = may & (better(key) | _is(key)) if key is not None else F.lit(False)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    winners = ranked(rows.filter(won), order, name="importance-winners")
    names = ("doc_id", "n_words", "n_features", "weight", "score")
    rest = rows.filter(~won).select(*names, F.lit(None).cast("long").alias("rank"))
    return winners.select(*names, (F.col("rank") + 1).alias("rank")).unionByName(rest)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row per document."""
    return draw(docs, benchmark).drop("n_words")


def oracle() -> str:
    from .manifest import LOWER, SQL_CRC_TABLE, UPPER, sql_crc32

    def counted(name: str, key: str) -> str:
        grams = " UNION ALL ".join(f"SELECT {key}, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS f FROM {name}w"
                                   for n in range(1, LENGTHS + 1))
        return rf"""
{name}w AS (SELECT {key}, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM {name}),
{name}f AS MATERIALIZED (SELECT {key}, f, count(*) AS n FROM ({grams}) GROUP BY ALL)"""
    return f"""
WITH crc AS MATERIALIZED (SELECT {SQL_CRC_TABLE} AS tbl),{counted("documents", "doc_id")},{counted("benchmark", "item_id")},
c AS MATERIALIZED (SELECT f, {sql_crc32("f", "tbl")} % {BUCKETS} AS b FROM (SELECT DISTINCT f FROM (SELECT f FROM documentsf UNION ALL SELECT f FROM benchmarkf)), crc),
s AS (SELECT b, sum(n) AS n FROM documentsf JOIN c USING (f) GROUP BY b),
t AS (SELECT b, sum(n) AS n FROM benchmarkf JOIN c USING (f) GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS}) AS DOUBLE)
                                     / CAST((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain
      FROM s FULL JOIN t USING (b)),
w AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM documentsf JOIN c USING (f) JOIN g USING (b) GROUP BY doc_id),
r AS (SELECT doc_id, len(w) >= {LEAST_WORDS} AS may, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
             CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM documentsw LEFT JOIN w USING (doc_id)),
o AS (SELECT *, CASE WHEN may THEN row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (may) OVER () AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank FROM o"""
