"""SimHash near-dedup by the generalised pigeonhole principle.

A bit of a fingerprint is the majority among the hashes of a text's three-word
shingles.  Two fingerprints link when at most three of 64 bits differ.

The bits are cut into partitions.  Give a fingerprint q a number of units u_i per
partition that sum to four; a fingerprint within three bits of q then differs from it
by fewer than u_i bits in some partition i (if it differed by u_i or more in each, it
would differ by four).  So q need only look up, in each partition with units, the
values that differ from its own by fewer than u_i bits.  Any such deal is
complete; a good one avoids values that many fingerprints share:

- bits that go together are put into one partition, so that popularity gathers in
  few partitions instead of spreading over all;
- a histogram of each group of 16 bits gives the number of fingerprints near any
  value (exact for a group, by independence for a pair of groups);
- per fingerprint a dynamic programme over the partitions deals the four units at
  the least estimated cost of lookups and candidates.

Four partitions of a group each or two of a pair each: the cheaper one in sum
over all fingerprints is taken, wide partitions for large tables; both are complete.
Candidates are verified inside the join, so only links come out of it.  Equal
fingerprints are one class before any lookup.

What reaches the driver: 64 x 64 bit counts and at most 4 x 65,536 histogram
numbers, whatever the input.

Defined results: null, empty and blank text has fingerprint zero, linked like any
other; a null doc_id keeps its row and joins its fingerprint's class, and never
is the smallest id (a component without any id has a null component_id); repeated
rows share class and component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import prepare
from .graph import components
from .ranks import stored

SHINGLE = 3
SEED = 42
BITS = 64
MOST = 3                         # differing bits of a link
GROUP = 16                       # bits of a group: its histogram has 2^16 numbers
GROUPS = BITS // GROUP
PLANS = ((1, 1, 1, 1), (2, 2))   # groups in each partition
LOOKUP = 64                      # a lookup (a shuffled row) costs as much as so many candidates
CHUNK = 1 << 18                  # shingles hashed at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprint_rows(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The fingerprint of every text (uint64)."""
    n_texts = len(off) - 1
    ones, total = np.zeros((n_texts, BITS), np.int64), np.zeros(n_texts, np.int64)
    blank = tokens.BLANK[raw]
    start, end = ~blank, ~blank
    start[1:] &= blank[:-1]
    end[:-1] &= blank[1:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(raw))]
    start[edge] = ~blank[edge]
    end[edge - 1] = ~blank[edge - 1]
    ws, we = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(ws):
        return np.zeros(n_texts, np.uint64)
    first = np.searchsorted(ws, off)
    # words one blank apart: where each word lies in the joined bytes
    size = we - ws + 1
    to = np.cumsum(size) - size
    joined = np.full(int(to[-1] + size[-1]), 32, np.uint8)
    inside = np.flatnonzero(~blank)
    word = np.searchsorted(ws, inside, "right") - 1
    joined[to[word] + inside - ws[word]] = _LOWER[raw[inside]]
    data = joined.tobytes()
    text = np.searchsorted(first, np.arange(len(ws)), "right") - 1
    last = np.minimum(np.arange(len(ws)) + SHINGLE, first[text + 1]) - 1
    whole = (last - np.arange(len(ws)) == SHINGLE - 1) | (np.arange(len(ws)) == first[text])
    at = np.flatnonzero(whole)                                # a text of fewer words is one shingle
    for s in range(0, len(at), CHUNK):
        i = at[s:s + CHUNK]
        a, b = to[i].tolist(), (to[last[i]] + size[last[i]] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(data[x:y], SEED) for x, y in zip(a, b)], np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.diff(text[i], prepend=-1))
        ones[text[i][heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        total += np.bincount(text[i], minlength=n_texts)
    return (ones * 2 > total[:, None]) @ (np.uint64(1) << np.arange(BITS, dtype=np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, off in tokens.pieces(batch.column(1)):
            fp = fingerprint_rows(raw, off)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def _fps(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each two bits are both set, and the number of rows (last)."""
    both, n = np.zeros((BITS, BITS), np.int64), 0
    for batch in batches:
        for s in range(0, batch.num_rows, 1 << 14):
            fp = _fps(batch)[s:s + (1 << 14)]
            bits = ((fp[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            n += len(fp)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), n))], ["cell", "n"])


def grouped_bits(fps: DataFrame) -> np.ndarray:
    """GROUPS rows of GROUP bits: the bits of a group go together more than others do."""
    rows = fps.select("fp").mapInArrow(_together, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for r in rows:
        cells[r.cell] = r.n
    n = max(cells[-1], 1.0)
    both = cells[:-1].reshape(BITS, BITS) / n
    p = np.diag(both)
    spread = np.sqrt(p * (1 - p))
    with np.errstate(divide="ignore", invalid="ignore"):
        like = np.abs(np.nan_to_num((both - np.outer(p, p)) / np.outer(spread, spread), posinf=0.0, neginf=0.0))
    np.fill_diagonal(like, 0)
    free, out = list(range(BITS)), []
    for _ in range(GROUPS):
        group = [max(free, key=lambda b: (like[b, free].max(), -b))]
        free.remove(group[0])
        while len(group) < GROUP:
            bit = max(free, key=lambda b: (like[b, group].mean(), -b))
            group.append(bit)
            free.remove(bit)
        out.append(sorted(group))
    return np.array(out)


def values(fp: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Each fingerprint's value in each group (rows x GROUPS)."""
    out = np.zeros((len(fp), len(bits)), np.int64)
    for g, row in enumerate(bits):
        for i, b in enumerate(row.tolist()):
            out[:, g] |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
    return out


def histograms(fps: DataFrame, bits: np.ndarray) -> np.ndarray:
    """GROUPS x 2^GROUP: how many fingerprints have each value."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GROUPS << GROUP, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount((values(_fps(batch), bits) + (np.arange(GROUPS) << GROUP)).ravel(), minlength=len(total))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["cell", "n"])

    per = fps.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(GROUPS << GROUP, np.int64)
    got = per.toPandas()
    out[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out.reshape(GROUPS, 1 << GROUP)


def rings(histogram: np.ndarray) -> np.ndarray:
    """(groups, distance 0..MOST, value): fingerprints whose value lies at that distance."""
    f = np.zeros((len(histogram), MOST + 1, 1 << GROUP))
    f[:, 0] = histogram
    at = np.arange(1 << GROUP)
    for bit in range(GROUP):
        near = f[:, :, at ^ (1 << bit)]
        f[:, 1:] += near[:, :-1]
    return f


def masks(width: int, radius: int) -> np.ndarray:
    """All values of `width` bits with at most `radius` set."""
    return np.array([sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(width), k)], np.int64)


def costs(value: np.ndarray, ring: np.ndarray, n: float, plan: tuple[int, ...]) -> np.ndarray:
    """rows x partitions x units 0..MOST+1: estimated cost of giving a partition so many units."""
    out, g = np.zeros((len(value), len(plan), MOST + 2)), 0
    for i, wide in enumerate(plan):
        at = [ring[j][:, value[:, j]] for j in range(g, g + wide)]          # distance x rows
        part = at[0]
        for other in at[1:]:
            part = np.stack([sum(part[a] * other[d - a] for a in range(d + 1)) for d in range(MOST + 1)]) / max(n, 1.0)
        for d in range(MOST + 1):
            out[:, i, d + 1] = part[:d + 1].sum(0) + LOOKUP * len(masks(wide * GROUP, d))
        g += wide
    return out


def deal(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units per row and partition, the cost): MOST + 1 units at the least cost,
    by a dynamic programme over the partitions."""
    rows, parts, _ = cost.shape
    best = np.full((rows, MOST + 2), np.inf)
    best[:, 0] = 0
    choice = np.zeros((rows, parts, MOST + 2), np.int8)
    for i in range(parts):
        new = np.full_like(best, np.inf)
        for spent in range(MOST + 2):
            tries = np.stack([best[:, spent - u] + cost[:, i, u] for u in range(spent + 1)], 1)
            choice[:, i, spent] = tries.argmin(1)
            new[:, spent] = tries.min(1)
        best = new
    units, left = np.zeros((rows, parts), np.int64), np.full(rows, MOST + 1)
    for i in reversed(range(parts)):
        units[:, i] = choice[np.arange(rows), i, left]
        left -= units[:, i]
    return units, best[:, MOST + 1]


def _keys(value: np.ndarray, plan: tuple[int, ...]) -> list[np.ndarray]:
    """Per partition each row's value (up to 32 bits)."""
    out, g = [], 0
    for wide in plan:
        out.append(sum(value[:, g + j] << (GROUP * j) for j in range(wide)))
        g += wide
    return out


def links(fps: DataFrame, plan: tuple[int, ...] | None = None) -> DataFrame:
    """(a, b): all pairs a < b of the distinct fingerprints `fps` (column fp) that
    differ in at most MOST bits.  `plan` fixes the partitions (else the cheaper)."""
    prepare(fps.sparkSession)
    bits = grouped_bits(fps)
    histogram = histograms(fps, bits)
    ring, n = rings(histogram), float(histogram[0].sum())

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(PLANS))
        for batch in batches:
            for s in range(0, batch.num_rows, 1 << 14):
                value = values(_fps(batch)[s:s + (1 << 14)], bits)
                total += [deal(costs(value, ring, n, p))[1].sum() for p in PLANS]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(PLANS)), pa.int32()), pa.array(total)], ["plan", "cost"])

    if plan is None:
        told = fps.select("fp").mapInArrow(weigh, "plan int, cost double").groupBy("plan").agg(F.sum("cost").alias("cost"))
        by = told.orderBy("cost", "plan").first()
        plan = PLANS[by.plan if by else 0]

    def lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1 << 12):
                fp = _fps(batch)[s:s + (1 << 12)]
                value = values(fp, bits)
                units, _ = deal(costs(value, ring, n, plan))
                for i, key in enumerate(_keys(value, plan)):
                    for u in range(1, MOST + 2):
                        rows = np.flatnonzero(units[:, i] == u)
                        near = masks(plan[i] * GROUP, u - 1)
                        step = max(1, (1 << 20) // len(near))
                        for r in range(0, len(rows), step):
                            some = rows[r:r + step]
                            probe = (key[some][:, None] ^ near[None, :]).ravel() | (i << 32)
                            yield pa.RecordBatch.from_arrays([pa.array(probe), pa.array(np.repeat(fp[some], len(near)).view(np.int64))], ["key", "a"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _fps(batch)
            for i, key in enumerate(_keys(values(fp, bits), plan)):
                yield pa.RecordBatch.from_arrays([pa.array(key | (i << 32)), pa.array(fp.view(np.int64))], ["key", "b"])

    probes = fps.select("fp").mapInArrow(lookups, "key long, a long")
    held = fps.select("fp").mapInArrow(index, "key long, b long")
    return probes.join(held, "key").filter(F.col("a") < F.col("b")).filter(f"bit_count(a ^ b) <= {MOST}").select("a", "b").distinct()


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    rows = stored(fingerprints(docs), "simhash-rows")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    found = components(links(classes)).toDF("fp", "comp")
    named = classes.join(found, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    label = stored(named.select("fp", "comp").join(least, "comp").drop("comp"), "simhash-labels")
    return rows.join(label, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One doc_id per component: its smallest."""
    return cluster(docs).filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()


def report(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    return cluster(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
