"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

1. The benchmark's windows (13 words, or the whole item when it is shorter) are
   hashed; the distinct windows form the set.  It is broadcast only when its
   counted size is under `max_broadcast_windows`; otherwise the join shuffles.
2. Every document's words are scanned: each window is hashed and probed.
3. Hits are verified word by word in the document, so a hash collision cannot
   produce a hit; then words are counted and spans or documents removed.

DataFrame functions only.  Windows never leave the scan unless they hit, so the
shuffle carries the texts once and the hits.

Defined results: a null or wordless text has no words and no hits; repeated rows
get equal results; an empty benchmark or an empty table gives no hits; other
columns of `docs`, whatever their names, pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"                     # in a text as it stands
WORD_AND_GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" + GAP
RULE = 20          # contaminated when 20 * n_hit >= n_words, and n_hit > 0


def words(text: Column) -> Column:
    """Normalised words: A-Z lower-cased, everything else as it stands."""
    low = F.translate(text, UPPER, UPPER.lower())
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _windows(w: Column, n: int) -> Column:
    """Structs (pos from 0, len, h) of every window of n words."""
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"),
                                                  F.xxhash64(F.slice(w, i + 1, n)).alias("h")))


def benchmark_windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """Distinct windows: h, len, window (words joined by a blank), items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    items = items.filter(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(n)))
    per = items.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
    per = per.select("item", "len", F.slice("w", F.col("i"), F.col("len")).alias("s"))
    return (per.groupBy(F.xxhash64("s").alias("h"), "len", F.array_join("s", " ").alias("window"))
            .agg(F.collect_set("item").alias("items")))


def scan(docs: DataFrame, benchmark: DataFrame, out: str = "decontamination", n: int = 13,
         max_broadcast_windows: int = 2_000_000) -> DataFrame:
    """`docs` plus one struct column `out`: n_words, n_hit, items (sorted array
    of the item ids with occurring windows), spans (word positions [start, end)
    of verified windows, ordered) and contaminated."""
    bench = benchmark_windows(benchmark, n)
    size, lens = bench.agg(F.count(F.lit(1)), F.collect_set("len")).first()   # one row: at most n lengths
    base = packed(docs, "doc_id", "text").withColumns({"_dc_id": F.col("doc_id"), "_dc_th": F.md5(F.coalesce("text", F.lit("")))})
    if size:
        probe = base.select("_dc_id", "_dc_th", words(F.col("text")).alias("_w")).select(
            "_dc_id", "_dc_th", F.inline(F.concat(*[_windows(F.col("_w"), k) for k in sorted(lens)])))
        keyed = F.broadcast(bench) if size <= max_broadcast_windows else bench
        hits = (probe.join(keyed, ["h", "len"])
                .groupBy("_dc_id", "_dc_th")
                .agg(F.collect_set(F.struct("pos", "len", "window", "items")).alias("_hits")))
        hits = hits.withColumnsRenamed({"_dc_id": "_h_id", "_dc_th": "_h_th"})
        base = base.join(hits, F.col("_dc_id").eqNullSafe(F.col("_h_id")) & (F.col("_dc_th") == F.col("_h_th")), "left")
    else:
        base = base.withColumn("_hits", F.lit(None).cast(
            "array<struct<pos:int,len:int,window:string,items:array<string>>>"))
    base = base.withColumn("_w", words(F.col("text")))
    real = F.sort_array(F.filter(F.coalesce("_hits", F.array()), lambda x: F.array_join(
        F.slice(F.col("_w"), x["pos"] + 1, x["len"]), " ") == x["window"]))
    base = base.withColumn("_hits", real)
    covered = F.aggregate("_hits", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda acc, x: F.struct(
        F.greatest(acc["end"], x["pos"] + x["len"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(acc["end"], x["pos"]))).alias("n")))
    base = base.withColumns({
        "_n": F.size("_w").cast("long"), "_hit": covered["n"].cast("long"),
        "_items": F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda x: x["items"])))),
        "_spans": F.transform("_hits", lambda x: F.struct(x["pos"].alias("start"), (x["pos"] + x["len"]).alias("end")))})
    result = F.struct(F.col("_n").alias("n_words"), F.col("_hit").alias("n_hit"), F.col("_items").alias("items"),
                      F.col("_spans").alias("spans"),
                      ((F.col("_hit") > 0) & (RULE * F.col("_hit") >= F.col("_n"))).alias("contaminated"))
    return base.select(*unpacked(docs.columns, out), result.alias(out))


def remove_documents(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents that are not contaminated, columns as they came."""
    return scan(docs, benchmark, out="_dc", **kw).filter(~F.col("_dc.contaminated")).drop("_dc")


def remove_spans(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """Every document, with each hit word (and the gap after it) cut from its text."""
    found = scan(docs, benchmark, out="_dc", **kw)
    pieces = F.regexp_extract_all("text", F.lit(WORD_AND_GAP), F.lit(0))
    lead = F.regexp_extract("text", "^" + GAP, 0)
    left = F.filter(pieces, lambda p, i: ~F.exists(F.col("_dc.spans"), lambda s: (s["start"] <= i) & (i < s["end"])))
    cut = F.when(F.col("_dc.n_hit") > 0, F.concat(lead, F.array_join(left, ""))).otherwise(F.col("text"))
    return found.withColumn("text", cut).drop("_dc")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row per document."""
    d = scan(docs.select("doc_id", "text"), benchmark, out="_dc")
    return d.select("doc_id", F.col("_dc.n_words").alias("n_words"), F.col("_dc.n_hit").alias("n_hit"),
                    F.size("_dc.items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("_dc.items", ","), 256).alias("items_sha256"),
                    F.col("_dc.contaminated").alias("contaminated"))
