"""Merkle dataset manifest with inclusion proofs.

Every row is a leaf; per group (language) the leaves, in order, form a tree of
runs of eight; the groups' roots, in order, form another, whose top is the root
of the dataset.

A leaf's rank within its group, in octal, names its run on every level.  Rank
digits are grouped away one after the other inside blocks of 8^4 leaves: each
step nests the children of a run, with their digests joined, into one struct, so
a block ends as one nested row and all four steps share one exchange.  The
blocks' digests are rolled up in the same way until one digest per group is left
(a round divides the rows by 4096).  On the way back a block's path to the root
arrives as one more row of the block's own group, so that exploding the nested
row gives every leaf its whole path: no join looks up a sibling, and no row
holds more than a block.

DataFrame functions only.  Between rounds only rows of digests are stored (no
text), in the shared folder.

Defined results: each null field counts as `-`, so null and empty differ; a null
group comes first; null ids come first in their group, rows with one id follow
each other by digest, repeated rows are leaves of their own; an empty table has
no proofs; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGITS = 4                       # rank digits per block
WIDE = 8                         # nodes in a run
HEX = 64                         # characters of a digest
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*fields: Column) -> Column:
    """sha256 of the fields, each `-` if null, else its UTF-8 length, `:` and value."""
    def told(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.sha2(F.concat(*[told(c) for c in fields]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def siblings(path: Column) -> Column:
    """All sibling digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def _height(size: Column) -> Column:
    """Levels of a tree over `size` nodes: the octal digits of size - 1."""
    return F.when(size > 1, F.length(F.conv((size - 1).cast("string"), 10, WIDE))).otherwise(0)


def _nested(nodes: DataFrame, tops: DataFrame | None = None) -> DataFrame:
    """One row per block of `nodes` (g, rank, height, node, item): g, block, height,
    digest, kids (nested, four levels), run (their digests joined) and top (the
    struct that `tops` (g, block, top) holds for the block)."""
    digit = [F.pmod(F.shiftright("rank", 3 * i), F.lit(WIDE)).cast("int").alias(f"d{i}") for i in range(DIGITS)]
    t = nodes.select("g", F.shiftright("rank", 3 * DIGITS).alias("block"), *digit, "height", "node", "item")
    kid = F.struct(F.col("d0").alias("d"), "node", "item")
    t = t.select("g", "block", *[f"d{i}" for i in range(1, DIGITS)], "height", kid.alias("kid"))
    top = F.lit(None).cast("string")
    if tops is not None:
        kind = {f.name: f.dataType for f in t.schema}
        blank = [F.lit(None).cast(kind[c]).alias(c) for c in t.columns[2:]]
        top = F.lit(None).cast(tops.schema["top"].dataType)
        t = t.withColumn("top", top).unionByName(tops.select("g", "block", *blank, "top"))
    else:
        t = t.withColumn("top", top)
    t = t.repartition("g", "block")
    for level in range(1, DIGITS + 1):
        above = [f"d{i}" for i in range(level, DIGITS)]
        t = (t.groupBy("g", "block", *above)
             .agg(F.sort_array(F.collect_list("kid")).alias("kids"), F.max("height").alias("height"),
                  F.first("top", ignorenulls=True).alias("top"))
             .withColumn("run", F.array_join("kids.node", "")))
        node = F.when(F.col("height") >= level, F.sha2("run", 256)).otherwise(F.element_at("kids.node", 1))
        t = t.withColumn("node", F.when(F.size("kids") > 0, node))
        if level < DIGITS:
            one = F.struct(F.col(above[0]).alias("d"), "node", "run", "kids")
            t = t.select("g", "block", *above[1:], "height", F.when(F.size("kids") > 0, one).alias("kid"), "top")
    return t


def _rounds(nodes: DataFrame, name: str) -> list[DataFrame]:
    """`nodes` and, round by round, the digests of its blocks; the last has one row per g."""
    levels = [nodes]
    while True:
        up = _nested(levels[-1]).select("g", F.col("block").alias("rank"), F.greatest(F.lit(0), F.col("height") - DIGITS).alias("height"),
                                        "node", F.lit(None).cast("string").alias("item"))
        levels.append(stored(up, name))
        if not levels[-1].agg(F.max("height")).first()[0]:
            return levels


def _descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Every first-level node with its path: item, node, path and the other fields
    of `top`.  `tops` (g, block, top) holds the struct of each tree's top."""
    for nodes in reversed(levels[:-1]):
        t = _nested(nodes, tops).select("g", "block", "height", "run", "kids", "top")
        for level in range(DIGITS, 0, -1):
            t = t.select("g", "block", "height", "run", "top", F.explode("kids").alias("kid"))
            step = F.struct(F.expr(f"substring(run, 1, kid.d * {HEX})").alias("before"),
                            F.expr(f"substring(run, (kid.d + 1) * {HEX} + 1)").alias("after"))
            path = F.when(F.col("height") >= level, F.concat(F.array(step), F.col("top.path"))).otherwise(F.col("top.path"))
            t = t.withColumn("top", F.col("top").withField("path", path)).withColumn("block", F.col("block") * WIDE + F.col("kid.d"))
            if level > 1:
                t = t.select("g", "block", "height", F.col("kid.run").alias("run"), F.col("kid.kids").alias("kids"), "top")
        t = t.select("g", "block", "top", F.col("kid.node").alias("node"), F.col("kid.item").alias("item"))
        tops = t
    return tops


def leaves(docs: DataFrame, group: str = "lang", fields: Sequence[str] = FIELDS, extra: dict[str, Column] | None = None) -> DataFrame:
    """g (the group as a key that is never null and sorts nulls first), id, leaf and
    the `extra` columns: what is stored of a document."""
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    return docs.select(g.alias("g"), F.col(fields[0]).alias("id"), digest(*[F.col(f"`{c}`") for c in fields]).alias("leaf"),
                       *[c.alias(n) for n, c in (extra or {}).items()])


def prove(rows: DataFrame) -> DataFrame:
    """Rows of `leaves` with g, id, leaf, their extra columns, `path` (per level the
    digests before and after), `subroot` (of the group) and `root`."""
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "manifest-leaves")
    at = ranked(rows, [F.col("id").asc_nulls_first(), F.col("leaf").asc(), F.col("_row").asc()], "g", "manifest-ranks")
    extra = [c for c in rows.columns if c not in ("g", "_row", "leaf")]
    nodes = at.select("g", "rank", _height(F.col("size")).alias("height"), F.col("leaf").alias("node"), F.struct(*extra).alias("item"))
    trees = _rounds(nodes, "manifest-trees")
    subroots = ranked(trees[-1].select(F.col("g").alias("of"), "node"), [F.col("of").asc()], name="manifest-subroots")
    crown = _rounds(subroots.select(F.lit("").alias("g"), "rank", _height(F.col("size")).alias("height"), "node", F.col("of").alias("item")),
                    "manifest-crown")
    path = F.array().cast("array<struct<before:string,after:string>>").alias("path")
    groups = _descend(crown, crown[-1].select("g", F.col("rank").alias("block"), F.struct(path, F.col("node").alias("root")).alias("top")))
    tops = groups.select(F.col("item").alias("g"), F.lit(0).cast("long").alias("block"),
                         F.struct("top.path", "top.root", F.col("node").alias("subroot")).alias("top"))
    out = _descend(trees, stored(tops, "manifest-groups"))
    return out.select("g", *[F.col(f"item.{c}").alias(c) for c in extra], F.col("node").alias("leaf"), "top.path", "top.subroot", "top.root")


def manifest(docs: DataFrame, group: str = "lang") -> DataFrame:
    """One row per group: its name, number of leaves, subroot, and the root."""
    return (prove(leaves(docs, group)).groupBy("g").agg(F.count(F.lit(1)).alias("n_leaves"), F.first("subroot").alias("subroot"), F.first("root").alias("root"))
            .select(F.when(F.col("g") != "", F.expr("substring(g, 2)")).alias(group), "n_leaves", "subroot", "root"))


def report(docs: DataFrame) -> DataFrame:
    """The contract's row per document: proofs, and what a copy with some texts
    lower-cased folds to."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    other = digest(*[F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS])
    p = prove(leaves(docs, extra={"other": F.when(tampered, other)}))
    p = p.withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("path")))
    return p.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: CRC-32 of a string in DuckDB, byte by byte over a table made from the polynomial.
SQL_CRC_TABLE = ("list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)), "
                 "lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)))")


def sql_crc32(s: str, table: str) -> str:
    data = (f"list_transform(range(CAST(octet_length(encode({s})) AS BIGINT)), "
            f"lambda i: CAST('0x' || substr(hex(encode({s})), 2 * i + 1, 2) AS BIGINT))")
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), "
            f"lambda c, x: xor(c >> 8, {table}[(xor(c, x) & 255) + 1])), 4294967295)")


def oracle(levels: int = 8) -> str:
    """The contract's rows in DuckDB, for up to 8^levels leaves a group: plain joins
    with one table of runs per level."""
    def told(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"

    def tree(name: str, rows: str, proofs: str) -> str:
        """CTEs: {name}r{k} runs of level k; {name}p{k} proofs after k levels."""
        out = [f"{name}n0 AS ({rows})", f"{name}p0 AS ({proofs})"]
        for k in range(1, levels + 1):
            out.append(f"{name}r{k} AS (SELECT g, r // 8 AS r, max(h) AS h, list(node ORDER BY r) AS ns FROM {name}n{k - 1} GROUP BY g, r // 8)")
            out.append(f"{name}n{k} AS (SELECT g, r, h, CASE WHEN h >= {k} THEN sha256(array_to_string(ns, '')) ELSE ns[1] END AS node FROM {name}r{k})")
            at = f"(p.r // {8 ** (k - 1)}) % 8"
            b, a = f"array_to_string(ns[1:{at}], '')", f"array_to_string(ns[{at} + 2:], '')"
            out.append(f"{name}p{k} AS (SELECT p.* REPLACE (CASE WHEN s.h >= {k} THEN p.sib || {b} || {a} ELSE p.sib END AS sib, "
                       f"CASE WHEN s.h >= {k} THEN sha256({b} || cur || {a}) ELSE cur END AS cur) "
                       f"FROM {name}p{k - 1} p JOIN {name}r{k} s ON s.g = p.g AND s.r = p.r // {8 ** k})")
        return ",\n".join(out)
    high = "(SELECT count(*) FROM range(1, 22) t(e) WHERE pow(8, e - 1) < n)"
    return f"""
WITH crc AS MATERIALIZED (SELECT {SQL_CRC_TABLE} AS tbl),
d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({" || ".join(told(c) for c in FIELDS)}) AS leaf,
             CASE WHEN {sql_crc32("CAST(doc_id AS VARCHAR)", "tbl")} % 3 = 0
                  THEN sha256({" || ".join(told(f"translate(text, '{UPPER}', '{LOWER}')" if c == "text" else c) for c in FIELDS)}) END AS other
      FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM d),
{tree("t", f"SELECT g, r, {high} AS h, leaf AS node FROM l", "SELECT doc_id, leaf, g, r, coalesce(other, leaf) AS cur, '' AS sib FROM l")},
s AS (SELECT '' AS g, g AS grp, node, row_number() OVER (ORDER BY g) - 1 AS r, count(*) OVER () AS n FROM tn{levels}),
{tree("c", f"SELECT g, r, {high} AS h, node FROM s",
      f"SELECT p.doc_id, p.leaf, s.node AS subroot, s.g, s.r, p.cur, p.sib FROM tp{levels} p JOIN s ON s.grp = p.g")}
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM cp{levels}, (SELECT node AS root FROM cn{levels})"""
