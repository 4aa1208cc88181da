"""Merkle manifest against a plain-Python tree, and its edge cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from mercato.llm import manifest

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return H("".join(told(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree(nodes):
    """(root, per node its path: (digests before, digests after) per level)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(paths):
            run = at[i] // 8 * 8
            p.append((level[run:at[i]], level[at[i] + 1:run + 8]))
            at[i] //= 8
        level = [H("".join(level[s:s + 8])) for s in range(0, len(level), 8)]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, inner = [], {}
    for g in names:
        own = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        sub, paths = tree([leaf(r, r["text"]) for r in own])
        subs.append(sub)
        inner[g] = (own, paths)
    root, upper = tree(subs)
    out = []
    for g, sub, above in zip(names, subs, upper):
        for r, path in zip(*inner[g]):
            path = path + above
            text, i = r["text"], r["doc_id"]
            if text is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(r, text)
            for before, after in path:
                node = H("".join(before) + node + "".join(after))
            proof = H("".join("".join(b) + "".join(a) for b, a in path))
            out.append((i, leaf(r, r["text"]), sub, root, proof, node, node == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in manifest.report(df).collect()), key=str)


@pytest.fixture(scope="module")
def mixed(spark):
    """Groups of 1 to 700 rows, null and empty groups, ids and texts, repeated rows, clashing names."""
    rows = [(i, f"Text {i} É Ü" if i % 7 else None, ("a", None, "", "é", "b")[0 if i > 90 else i % 5], "s" if i % 3 else None, i if i % 11 else None)
            for i in range(700)]
    rows += [(None, "no Id", "a", "s", 1), (None, None, None, None, None), (5, "Twice", "b", "s", 2), (5, "Twice", "b", "s", 2), (7, "L" * 300_000, "x", "", 0)]
    rows += [(1000 + i, f"G{i}", f"lang{i}", "s", 1) for i in range(70)]                # many groups: a crown of three levels
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(1) for c in ("g", "rank", "size", "node", "item", "top", "block", "height", "leaf", "id")}).repartition(5)


def test_equals_plain_python(mixed):
    got = rows_of(mixed)
    assert got == brute([r.asDict() for r in mixed.collect()])
    assert {r[-1] for r in got} == {True, False}
    assert all(r[-1] for r in got if r[0] is None or zlib.crc32(str(r[0]).encode()) % 3)


@pytest.mark.parametrize("digits", (2,))
def test_small_blocks_give_the_same_tree(mixed, monkeypatch, digits):
    want = rows_of(mixed)
    monkeypatch.setattr(manifest, "DIGITS", digits)                                     # several rounds of blocks
    assert rows_of(mixed) == want


@pytest.mark.parametrize("n", (0, 1, 8, 9, 65))
def test_heights(spark, n):
    df = spark.createDataFrame([(i, f"T{i}", "en", "s", 2) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long")
    assert rows_of(df) == (brute([r.asDict() for r in df.collect()]) if n else [])


def test_blocks_share_one_exchange_and_proofs_need_no_join(mixed):
    nodes = mixed.select(F.lit("g").alias("g"), F.col("doc_id").alias("rank"), F.lit(4).alias("height"), F.lit("n").alias("node"), F.lit("i").alias("item"))
    tops = mixed.select(F.lit("g").alias("g"), F.lit(0).cast("long").alias("block"),
                        F.struct(F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.lit("r").alias("root")).alias("top"))
    plan = manifest._descend([nodes, nodes], tops)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_manifest_of_groups(mixed):
    per = {r.lang: r for r in manifest.manifest(mixed).collect()}
    subs = {(r[2], r[3]) for r in rows_of(mixed)}
    assert {(r.subroot, r.root) for r in per.values()} == subs
    assert sum(r.n_leaves for r in per.values()) == mixed.count() and None in per and "" in per
