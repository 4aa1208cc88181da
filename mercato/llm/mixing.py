"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are dealt into blocks.  Weights are rounded to shares
e / Q with sum Q.  Block g of a source is released at floor((g - 1) Q / e) and
due at ceil(g Q / e); earliest deadline first fills one block per slot.  At
every multiple of Q each source has had exactly its share, so the schedule
repeats with period Q: one period is simulated (Q steps over the sources, in
one row, whatever the corpus), the pattern of Q rows is broadcast, and a block's
slot follows from its number by arithmetic.  After any number of slots every
source is less than one block away from its target.

DataFrame functions only.  Ranks inside a source come from counts of id-hash
buckets, so a source that holds most rows is not ranked in one task.

epochs="cover": the schedule runs until every source has been read whole once;
sources with more weight than documents start again (epoch 2, 3, ...).
epochs="once": every document has one slot; a source that ends leaves its later
slots empty, and `balanced` marks the slots before the first source ends.

Defined results: a null source is a source of its own; a null doc_id ranks by
the hash of the empty string; repeated rows take places of their own; an empty
table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import packed, unpacked

BLOCK = 16                 # documents in a block
TEMPER = 0.85              # default target weight: documents ** TEMPER
RESOLUTION = 1024          # least Q; doubled until it is 8 times the number of sources
BUCKET_ROWS = 5000         # rows a rank bucket should hold, about


def _let(value: Column, then) -> Column:
    """Evaluate `value` once inside an expression."""
    return F.element_at(F.transform(F.array(value), then), 1)


def shares(sizes: DataFrame, weights: DataFrame | None = None, temper: float = TEMPER) -> DataFrame:
    """One row per source: _src, n_docs, q and e, the source's share of q.

    `sizes`: _src, n_docs.  `weights`: _src, weight (any positive scale; every
    source needs one); by default the tempered document counts.  Largest
    remainders are rounded up; every source gets 1 at least."""
    w = sizes.withColumn("w", F.pow(F.col("n_docs").cast("double"), F.lit(temper))) if weights is None else \
        sizes.join(weights.select("_src", F.col("weight").cast("double").alias("w")), "_src", "left") \
             .withColumn("w", F.coalesce("w", F.raise_error(F.concat(F.lit("no weight for source "), "_src")).cast("double")))
    every = Window.partitionBy()                    # one row per source: the number of sources bounds it
    n = F.count(F.lit(1)).over(every)
    w = w.withColumn("q", F.when(n * 8 <= RESOLUTION, RESOLUTION).otherwise(F.pow(2, F.ceil(F.log2(n * 8)))).cast("long"))
    w = w.withColumn("raw", F.col("q") * F.col("w") / F.sum("w").over(every.orderBy("_src").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)))
    w = w.withColumn("base", F.greatest(F.lit(1), F.floor("raw")).cast("long"))
    left = F.col("q") - F.sum("base").over(every)
    up = F.row_number().over(every.orderBy((F.col("raw") - F.col("base")).desc(), "_src"))
    down = F.row_number().over(every.orderBy(F.col("base").desc(), "_src"))
    w = w.withColumns({"left": left, "up": up, "down": down})
    e = F.col("base") + F.when(F.col("up") <= F.col("left"), 1).when(F.col("down") <= -F.col("left"), -1).otherwise(0)
    return w.select("_src", "n_docs", "q", e.cast("long").alias("e"))


def period(share: DataFrame) -> DataFrame:
    """The slots of one period: _src, c (1..e, the source's c-th block in it), t (slot from 0)."""
    row = share.agg(F.first("q").alias("q"), F.sort_array(F.collect_list(F.struct("_src", "e"))).alias("s"))

    def step(acc, t):
        # (deadline, place) of each source's next block; not yet released: last
        ready = F.transform(acc["done"], lambda k, i: _let(F.element_at(F.col("s"), i + 1)["e"], lambda e: F.struct(
            F.when(F.floor(k * F.col("q") / e) <= t, F.ceil((k + 1) * F.col("q") / e)).otherwise(F.lit(2**62)).alias("d"),
            i.alias("i"))))
        return _let(F.array_min(ready)["i"], lambda p: F.struct(
            F.transform(acc["done"], lambda k, i: k + F.when(i == p, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))).alias("done"),
            F.concat(acc["out"], F.array(p)).alias("out")))

    start = F.struct(F.transform("s", lambda _: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("out"))
    out = row.select("s", F.posexplode(F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("q") - 1), start, step)["out"]).alias("t", "p"))
    out = out.select(F.element_at("s", F.col("p") + 1)["_src"].alias("_src"), F.col("t").cast("long").alias("t"))
    return out.withColumn("c", F.row_number().over(Window.partitionBy("_src").orderBy("t")).cast("long"))


def _ranked(docs: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows with _src, _block, _seat; sizes): blocks number each source's documents by their id's MD5."""
    digits = max(1, int(math.log(max(docs.count(), 1) / BUCKET_ROWS, 16))) if not docs.isEmpty() else 1
    src = F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("source")))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = docs.withColumns({"_src": src, "_md": order}).withColumn("_bucket", F.substring("_md", 1, digits))
    counts = keyed.groupBy("_src", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_src").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)) - F.col("_n"))
    inside = F.row_number().over(Window.partitionBy("_src", "_bucket").orderBy("_md", "doc_id"))
    ranked = keyed.withColumn("_inside", inside).join(before.drop("_n"), ["_src", "_bucket"])
    rank = F.col("_before") + F.col("_inside") - 1
    ranked = ranked.withColumns({"_block": F.floor(rank / block) + 1, "_seat": rank % block + 1})
    return ranked.drop("_md", "_bucket", "_inside", "_before"), counts.groupBy("_src").agg(F.sum("_n").alias("n_docs"))


def mix(docs: DataFrame, weights: DataFrame | None = None, epochs: str = "cover", block: int = BLOCK,
        temper: float = TEMPER, out: str = "mix") -> DataFrame:
    """`docs` plus one struct column `out`: epoch, block, block_row, share (of
    `period` slots), period, release, deadline, slot, balanced.

    `weights`: columns source, weight.  Rows of a slot belong together; the
    mixture in order is `orderBy("slot", "block_row")`."""
    ranked, sizes = _ranked(packed(docs, "doc_id", "source"), block)
    if weights is not None:
        weights = weights.select(F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("source"))).alias("_src"), "weight")
    share = shares(sizes, weights, temper)
    every = Window.partitionBy()
    blocks = F.ceil(F.col("n_docs") / block)
    plan = share.withColumn("_n", blocks)
    plan = plan.withColumns({
        "_cover": F.max(F.ceil(F.col("_n") * F.col("q") / F.col("e"))).over(every),
        "_even": F.min(F.floor(F.col("_n") * F.col("q") / F.col("e"))).over(every)})
    # the plan has one row per source, the pattern q rows: both are bounded by the sources, not the documents
    placed = ranked.join(F.broadcast(plan), "_src")
    if epochs == "cover":
        most = F.ceil((F.floor(F.col("_cover") * F.col("e") / F.col("q")) + 1) / F.col("_n"))
        placed = placed.withColumn("_epoch", F.explode(F.sequence(F.lit(1).cast("long"), most)))
    else:
        placed = placed.withColumn("_epoch", F.lit(1).cast("long"))
    g = (F.col("_epoch") - 1) * F.col("_n") + F.col("_block")
    placed = placed.withColumn("_g", g).withColumn("c", (F.col("_g") - 1) % F.col("e") + 1)
    placed = placed.join(F.broadcast(period(share)), ["_src", "c"])
    slot = F.floor((F.col("_g") - 1) / F.col("e")) * F.col("q") + F.col("t")
    placed = placed.withColumn("_slot", slot)
    if epochs == "cover":
        placed = placed.filter((F.col("_slot") < F.col("_cover")) | (F.col("_epoch") == 1))
    info = F.struct(F.col("_epoch").alias("epoch"), F.col("_block").cast("long").alias("block"), F.col("_seat").cast("long").alias("block_row"),
                    F.col("e").alias("share"), F.col("q").alias("period"),
                    F.floor((F.col("_g") - 1) * F.col("q") / F.col("e")).alias("release"),
                    F.ceil(F.col("_g") * F.col("q") / F.col("e")).alias("deadline"),
                    F.col("_slot").cast("long").alias("slot"), (F.col("_slot") < F.col("_even")).alias("balanced"))
    return placed.select(*unpacked(docs.columns, out), info.alias(out))


def report(docs: DataFrame) -> DataFrame:
    """One row per scheduled document and epoch."""
    return mix(docs.select("doc_id", "source"), out="m").select("doc_id", "source", "m.*")
