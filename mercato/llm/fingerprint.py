"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (pieces between line ends, and between
sentences of a longer line).  Each paragraph hashes to a wide vector: 8 seeded
64-bit hashes give 120 lanes of 4 bits.  A text's fingerprint is the sum of its
paragraphs' vectors, lane by lane modulo 2^19, and their number modulo 2^40.  So
it does not depend on the order of paragraphs, and paragraphs are inserted or
deleted by adding or subtracting their vectors.

Centred on their mean, the lanes are random signs: the squared length of the
difference of two fingerprints estimates how many paragraphs differ, which gives
a likeness from 0 (nothing in common) to 1 (equal), within about 0.13.

Three lanes of 19 bits and a spare bit share one long, so a step is a few long
operations.  DataFrame functions only.

Defined results: null text is empty; an empty text has the zero fingerprint, is
like another empty text by 1 and like any other by 0; documents follow each
other by (doc_id, text), null ids first, the first follows the last; a single
document follows itself; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASHES = 8                              # seeded hashes of a paragraph
LONGS = HASHES * 5                      # three lanes each
LANES = LONGS * 3
NIBBLES = 0xF | 0xF << 20 | 0xF << 40
FIELDS = 0x7FFFF | 0x7FFFF << 20 | 0x7FFFF << 40
SPARE = 1 << 19 | 1 << 39 | 1 << 59
PARAGRAPH = r"\n+|(?<=[.!?]) +"
BLOCK = 1024                            # ids in a block of neighbours


def _let(value: Column, then) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH), lambda p: p != "")


def _parts(hashes: Column, j: int) -> Column:
    """Long j of a paragraph's vector."""
    return F.shiftrightunsigned(F.element_at(hashes, j // 5 + 1), 4 * (j % 5)).bitwiseAND(F.lit(NIBBLES))


def _hashes(paragraph: Column) -> Column:
    return F.array(*[F.xxhash64(F.lit(s), paragraph) for s in range(HASHES)])


def insert(vector: Column, paragraph: Column) -> Column:
    """The fingerprint with one more paragraph."""
    return _let(_hashes(paragraph), lambda h: F.array(
        (F.element_at(vector, 1) + 1) % (1 << 40),
        *[(F.element_at(vector, j + 2) + _parts(h, j)).bitwiseAND(F.lit(FIELDS)) for j in range(LONGS)]))


def delete(vector: Column, paragraph: Column) -> Column:
    """The fingerprint with one paragraph less."""
    return _let(_hashes(paragraph), lambda h: F.array(
        F.pmod(F.element_at(vector, 1) - 1, F.lit(1 << 40)),
        *[(F.element_at(vector, j + 2).bitwiseOR(F.lit(SPARE)) - _parts(h, j)).bitwiseAND(F.lit(FIELDS)) for j in range(LONGS)]))


def merge(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' paragraphs together."""
    return F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p, i: F.when(
        i == 0, (p["x"] + p["y"]) % (1 << 40)).otherwise((p["x"] + p["y"]).bitwiseAND(F.lit(FIELDS))))


def vector(text: Column) -> Column:
    """A text's fingerprint as longs: the number of paragraphs, then the lanes, three in a long."""
    return F.aggregate(paragraphs(text), F.array_repeat(F.lit(0).cast("long"), LONGS + 1), insert)


def as_string(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def _power(longs: Column, n: Column) -> Column:
    """Estimated squared length of lanes whose paragraphs count n (n may be negative in a difference)."""
    def lane(x, shift):
        # twice the lane less 15 n, as the nearest value to 0 modulo 2^20
        d = F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(0x7FFFF)) * 2 - n * 15
        c = F.pmod(d + (1 << 19), F.lit(1 << 20)) - (1 << 19)
        return (c * c).cast("double")
    total = F.aggregate(longs, F.lit(0.0), lambda s, x: s + lane(x, 0) + lane(x, 20) + lane(x, 40))
    return total / (85.0 * LANES)          # a doubled nibble has variance 85


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, about 2 * common / (size + size) else, at least 0."""
    lanes = lambda v: F.slice(v, 2, LONGS)
    diff = F.zip_with(lanes(a), lanes(b), lambda x, y: (x.bitwiseOR(F.lit(SPARE)) - y).bitwiseAND(F.lit(FIELDS)))
    n_a, n_b = F.element_at(a, 1), F.element_at(b, 1)
    apart = _power(diff, n_a - n_b)
    size = _power(lanes(a), n_a) + _power(lanes(b), n_b)
    return (F.when(a == b, 1.0).when((n_a == 0) | (n_b == 0), 0.0)
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / size))))


def _with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, vec and next (struct of text and vec of the following document).

    Ids are cut into blocks; a block's rows meet once and follow each other by a
    window.  A block's last row takes the first row of the next block that has
    rows, found over one row per block and, for those, one per 1024 blocks."""
    block = F.coalesce(F.expr(f"CAST(doc_id AS BIGINT) div {BLOCK}"), F.lit(-(2**62)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("block", block)
    firsts = (rows.groupBy("block").agg(F.min(F.struct("doc_id", "text"))["text"].alias("text"))
              .select("block", F.struct("text", vector(F.col("text")).alias("vec")).alias("start")))
    blocks = rows.select("block").distinct().withColumn("super", F.expr(f"block div {BLOCK}"))
    supers = blocks.groupBy("super").agg(F.min("block").alias("head"))
    order = Window.partitionBy().orderBy("super")     # one row per 2^20 ids
    supers = supers.select("super", F.coalesce(F.lead("head").over(order), F.min("head").over(Window.partitionBy())).alias("beyond"))
    blocks = blocks.withColumn("after", F.lead("block").over(Window.partitionBy("super").orderBy("block"))).join(supers, "super")
    follow = (blocks.select("block", F.coalesce("after", "beyond").alias("then"))
              .join(firsts.withColumnRenamed("block", "then"), "then").select("block", "start"))
    inside = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumn("vec", vector(F.col("text")))
    rows = rows.withColumn("next", F.lead(F.struct("text", "vec")).over(inside)).join(follow, "block")
    return rows.select("doc_id", "text", "vec", F.coalesce("next", "start").alias("next"))


def report(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    d = _with_next(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), "vec", F.col("next.vec").alias("next_vec"), edited.alias("edited"))
    d = d.select("doc_id", "n_chars", "vec", "next_vec", F.sha2("edited", 256).alias("edited_sha256"), vector(F.col("edited")).alias("edited_vec"))
    return d.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("vec")).alias("fingerprint"),
                    as_string(F.col("edited_vec")).alias("edited_fingerprint"),
                    likeness(F.col("vec"), F.col("edited_vec")).alias("near_edited"),
                    likeness(F.col("vec"), F.col("next_vec")).alias("near_next"))
