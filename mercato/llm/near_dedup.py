"""MinHash near-dedup with SetSketch registers.

A document's set is its distinct 5-word shingles.  Register i holds the
exponentially spaced, truncated minimum floor(1 - log_b x), where x is the
smallest of the set's exponential hashes; registers of a union are the maxima,
so sketches merge.  With b = 1.001 two registers agree about as often as the
sets overlap, so bands of three registers find the candidates (a pair at 0.75
is missed with probability (1 - 0.75^3)^21, about 1e-5).  Candidates are first
weighed by the joint maximum-likelihood estimate of the overlap from the counts
of larger, smaller and equal registers, then verified on the full sets.

Equal sets are one class before any pairing, so copies cost one sketch.  In a
band's bucket every member is paired with two leaders only; after the links
found that way are joined into components, the members of a bucket that are
still outside its largest component are compared with the rest inside the join,
by their sizes and registers, and by a bound on the intersection: shingles that
few documents have are matched by a join of their own, and a pair that shares
none of them can only share the others.  Only pairs that may reach the threshold
come out of the joins.  So no candidate pair between different components is lost, and a
bucket of loosely similar texts emits next to nothing.

Defined results: null or wordless text has an empty set and no links; fewer than
five words count as one shingle; rows repeated in id and text are one document,
rows that share an id but not the text are two that carry the same id; a null
doc_id keeps its row, unlinked, with a null component and kept = true; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import cut, prepare
from .graph import components
from .ranks import stored

SHINGLE = 5
PERCENT = 75                       # linked when 100 * intersection >= PERCENT * union
ROWS, BANDS = 3, 21
REGISTERS = ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, 65535      # register spacing b, rate a, largest register value
RARE = 8                           # documents that may have a rare shingle
AGREE = 28                         # of 63 registers agree at least, in a pair at 0.75 (missed with probability 1e-8)
MARGIN = 0.30                      # estimates below 0.75 - MARGIN (over five deviations) are dropped

_R = np.random.Generator(np.random.PCG64(41))
_XOR = _R.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_MUL = _R.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (uint16), one row per set; an empty set has zeros."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    x = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0] + [len(sets[i]) for i in full])[:-1]
    low = np.empty((len(full), REGISTERS), np.float64)
    for r in range(REGISTERS):
        y = (x ^ _XOR[r]) * _MUL[r]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        low[:, r] = np.minimum.reduceat(y, at)
    exponential = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    out[full] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint16)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def _marks(regs: np.ndarray) -> np.ndarray:
    """The registers' low bytes, seven in a long, for comparisons inside a join."""
    low = (regs & 0xFF).astype(np.int64).reshape(len(regs), -1, 7)
    return (low << (8 * np.arange(7))).sum(2)


def _agree(x: str, y: str) -> str:
    """SQL: how many registers' low bytes agree (a byte of the XOR is zero)."""
    sevens, tops = sum(0x7F << 8 * i for i in range(7)), sum(0x80 << 8 * i for i in range(7))
    differ = " + ".join(f"bit_count(((({x}{i} ^ {y}{i}) & {sevens}L) + {sevens}L | ({x}{i} ^ {y}{i})) & {tops}L)" for i in range(REGISTERS // 7))
    return f"({REGISTERS} - ({differ}))"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in tokens.pieces(batch.column(1)):
            words, first, _ = tokens.word_hashes(data, off)
            sets = tokens.shingle_sets(words, first, SHINGLE)
            regs = registers(sets)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a),
                batch.column(2).slice(a, b - a),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([r.tobytes() for r in regs], pa.binary()),
                pa.array(list(_marks(regs)), pa.list_(pa.int64())),
            ], ["doc_id", "th", "n_shingles", "set_id", "regs", "marks"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, th (text hash), n_shingles, set_id (128 bits: equal sets, equal id), regs, marks."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(
        _sketches, f"doc_id {kind}, th long, n_shingles long, set_id binary, regs binary, marks array<long>")


_GRID = np.linspace(0.0, 1.0, 101)


def likeliest_overlap(larger, smaller, equal, n_u, n_v) -> np.ndarray:
    """Joint maximum-likelihood Jaccard estimate on a grid, vectorised: counts of
    registers where U is larger, smaller and equal; sizes of both sets."""
    u = (n_u / (n_u + n_v))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * _GRID[None, :]
    def p(x): return np.clip(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1.0)
    more, less = p(u - v * j), p(v - u * j)
    same = np.clip(1 - more - less, 1e-12, 1.0)
    like = larger[:, None] * np.log(more) + smaller[:, None] * np.log(less) + equal[:, None] * np.log(same)
    return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs (a, b, n_a, regs_a, n_b, regs_b) whose estimate may reach the threshold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (3, 5))
        larger, smaller = (ra > rb).sum(1), (ra < rb).sum(1)
        n_a, n_b = (np.asarray(batch.column(i), dtype=np.float64) for i in (2, 4))
        est = likeliest_overlap(larger, smaller, REGISTERS - larger - smaller, n_a, n_b)
        yield batch.select([0, 1]).filter(pa.array(est >= PERCENT / 100 - MARGIN))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text_a, text_b) whose full sets meet the rule."""
    def sets(column):
        for _, _, data, off in tokens.pieces(column):
            words, first, _ = tokens.word_hashes(data, off)
            yield from tokens.shingle_sets(words, first, SHINGLE)

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            ok = []
            for x, y in zip(sets(part.column(2)), sets(part.column(3))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield part.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.filter(f"{x} <> {y}").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def verify(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among candidate pairs (a, b): estimate first, then full sets.

    Each pair carries the text of `b` to the rows of `a`; a leader with many
    pairs is a skewed join key, which AQE splits."""
    kind = classes.schema["rep"].dataType.simpleString()
    side = classes.select("rep", "n_shingles", "regs")
    weigh = (pairs.join(side.toDF("a", "n_a", "regs_a"), "a").join(side.toDF("b", "n_b", "regs_b"), "b")
             .filter(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
             .select("a", "b", "n_a", "regs_a", "n_b", "regs_b"))
    likely = cut(weigh.mapInArrow(_plausible, f"a {kind}, b {kind}"))
    wanted = likely.select(F.col("a").alias("rep")).union(likely.select(F.col("b").alias("rep"))).distinct()
    text = wanted.join(texts, "rep").dropDuplicates(["rep"])       # repeated rows count once
    full = (likely.join(text.toDF("b", "text_b"), "b").join(text.toDF("a", "text_a"), "a")
            .select("a", "b", "text_a", "text_b"))
    return cut(full.mapInArrow(_linked, f"a {kind}, b {kind}"))


def _hashed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in tokens.pieces(batch.column(1)):
            words, first, _ = tokens.word_hashes(data, off)
            sets = tokens.shingle_sets(words, first, SHINGLE)
            rows = pa.array(np.repeat(np.arange(a, b), [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(np.concatenate(sets).view(np.int64))], ["rep", "shingle"])


def rare_shingles(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, shingle) for the shingles that at most RARE of `reps` have."""
    kind = reps.schema["rep"].dataType.simpleString()
    text = reps.join(texts, "rep").dropDuplicates(["rep"])
    own = text.select("rep", "text").mapInArrow(_hashed_sets, f"rep {kind}, shingle long")
    few = own.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= RARE).select("shingle", "n")
    return own.join(few, "shingle")


def links(docs: DataFrame, sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, links): a representative per distinct set, and verified links
    between representatives that join exactly the components of all links."""
    classes = cut(sketched.filter("n_shingles > 0 and doc_id is not null").groupBy("set_id")
                  .agg(F.min(F.struct(F.col("doc_id").alias("id"), "th")).alias("rep"),
                       F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"), F.first("marks").alias("marks")))
    texts = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th")).alias("rep"), "text")

    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)])
    bands = classes.select("rep", F.posexplode(keys).alias("nth", "band"))
    leaders = (bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("first"),
                                         F.min_by("rep", F.xxhash64("rep")).alias("other")).filter("n > 1").drop("n"))
    members = cut(bands.join(leaders, "band"))           # buckets with company only
    star = members.select("rep", F.explode(F.array("first", "other")).alias("lead"))
    found = verify(_pairs(star, "rep", "lead"), classes, texts)

    # members outside their bucket's largest component meet the rest of the bucket
    comp = components(found).toDF("rep", "comp")
    placed = members.select("band", "nth", "rep").join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    per = placed.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = (per.groupBy("band").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("parts"))
               .filter("parts > 1").drop("parts"))
    mixed = cut(placed.join(largest, "band"))
    reps = mixed.select("rep", "comp").distinct()
    rare = cut(rare_shingles(reps.select("rep"), texts))
    many = range(REGISTERS // 7)
    side = (reps.join(classes.select("rep", "n_shingles", keys.alias("keys"), *[F.element_at("marks", i + 1).alias(f"m{i}") for i in many]), "rep")
            .join(rare.groupBy("rep").agg(F.count(F.lit(1)).alias("rare")), "rep", "left")
            .withColumn("common", F.col("n_shingles") - F.coalesce("rare", F.lit(0))).drop("rare"))
    side = cut(side)

    def named(df: DataFrame, a: str) -> DataFrame:
        return df.withColumnsRenamed({"rep": a, **{c: f"{c}_{a}" for c in ("comp", "main", "n_shingles", "common", "keys")},
                                      **{f"m{i}": f"{a}{i}" for i in many}})

    may = (f"comp_x <> comp_y and 100 * least(n_shingles_x, n_shingles_y) >= {PERCENT} * greatest(n_shingles_x, n_shingles_y) "
           f"and {_agree('x', 'y')} >= {AGREE}")
    # pairs that share no rare shingle: the intersection is at most the smaller count of common ones;
    # a pair comes out of the first band it shares
    bound = (f"100 * least(common_x, common_y) >= {PERCENT} * (n_shingles_x + n_shingles_y - least(common_x, common_y)) "
             "and array_position(zip_with(keys_x, keys_y, (p, q) -> p = q), true) = nth + 1")
    rows = mixed.drop("comp").join(side, "rep")
    outside = named(rows.filter("comp <> main").drop("main"), "x")
    others = named(rows.drop("nth"), "y")
    across = outside.join(others, (outside["band"] == others["band"]) & F.expr(f"(comp_y = main_y or x < y) and {may} and {bound}"))
    # pairs that share one: at most RARE documents have it
    seen = rare.filter("n > 1").select("rep", "shingle").join(side.drop("keys", "common"), "rep")
    left, right = named(seen, "x"), named(seen, "y")
    joint = left.join(right, (left["shingle"] == right["shingle"]) & F.expr(f"x < y and {may}"))
    rest = verify(_pairs(across.select("x", "y").union(joint.select("x", "y")), "x", "y"), classes, texts)
    return classes, found.union(rest)


def _labelled(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, th, n_shingles and head, the smallest (id, th) of its group."""
    sketched = cut(sketches(docs))
    classes, found = links(docs, sketched)
    label = (classes.select("set_id", "rep").join(components(found).toDF("rep", "comp"), "rep", "left")
             .select("set_id", F.coalesce("comp", "rep").alias("head")))
    return sketched.select("doc_id", "th", "n_shingles", "set_id").join(label, "set_id", "left").drop("set_id")


def cluster(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, th, n_shingles, component_id, kept."""
    component = F.when(F.col("n_shingles") > 0, F.col("head.id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return _labelled(docs).select("doc_id", "th", "n_shingles", component.alias("component_id"),
                                  F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group, that of its smallest id (of rows that share
    it, one text; of rows repeated in id and text, one); the columns as they came.
    Rows without words or id stay.

    Only what has to go or is repeated meets the documents again."""
    head = F.struct(F.col("doc_id").alias("id"), "th")
    acts = (_labelled(docs).filter("n_shingles > 0 and doc_id is not null")
            .groupBy(F.col("doc_id").alias("_nd_id"), F.col("th").alias("_nd_th"))
            .agg(F.count(F.lit(1)).alias("_nd_n"), F.first(F.col("head") == head).alias("_nd_kept")).filter("not _nd_kept or _nd_n > 1"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    acts = stored(acts.drop("_nd_n"), "near-acts")
    at = rows.join(acts, (F.col("row.doc_id") == F.col("_nd_id")) & (F.xxhash64("row.text") == F.col("_nd_th")), "left")
    repeated = at.filter("_nd_kept").groupBy("_nd_id", "_nd_th").agg(F.first("row").alias("row"))
    out = at.filter("_nd_kept is null").select("row").union(repeated.select("row"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    return cluster(docs).drop("th")
