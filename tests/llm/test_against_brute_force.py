"""Operators that SQL does not express, against plain Python on a small table."""

import hashlib
import random
import re
from collections import Counter

import pytest

from mercato.llm import fingerprint, language_id, mixing, near_dedup, passages, suffix_dedup, suffix_sort, toxicity
from mercato.llm.common import table
from mercato.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark, sf_small):
    return {r.doc_id: r.text or "" for r in table(spark, sf_small, "documents").collect()}


def _components(links, nodes):
    parent = {i: i for i in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in nodes}


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _links(sets):
    ids = sorted(sets)
    return [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b]
            and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


def test_near_dedup(spark, sf_small, texts):
    sets = {i: _shingles(t) for i, t in texts.items()}
    comp = _components(_links(sets), sets)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op6_setsketch_near_dedup"](spark, sf_small).collect()}
    assert got == {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}


def test_near_dedup_chains_and_loose_groups(spark):
    """Neighbours linked only to each other, and many texts loosely like one base."""
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    rows = [(i, " ".join(words[i * 14:i * 14 + 200])) for i in range(60)]
    for i in range(100, 180):
        w = list(words[:200])
        for j in rng.sample(range(200), rng.randint(1, 30)):
            w[j] = f"q{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {i: _shingles(t) for i, t in rows}
    comp = _components(_links(sets), sets)
    got = {r.doc_id: r.component_id for r in near_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == comp and len(set(comp.values())) < len(rows) / 2


def test_register_comparison_in_sql(spark):
    import numpy as np
    from pyspark.sql import functions as F
    r = np.random.RandomState(0)
    regs = r.randint(0, 65536, (20, near_dedup.REGISTERS)).astype(np.uint16)
    for i in range(1, 20):
        same = r.permutation(near_dedup.REGISTERS)[:r.randint(0, 64)]
        regs[i, same] = regs[0, same]
    marks = near_dedup._marks(regs)
    n = near_dedup.REGISTERS // 7
    rows = [tuple(int(v) for v in marks[0]) + tuple(int(v) for v in marks[i])
            + (int((((regs[0] ^ regs[i]) & 0xFF) == 0).sum()),) for i in range(20)]
    df = spark.createDataFrame(rows, [*[f"x{i}" for i in range(n)], *[f"y{i}" for i in range(n)], "want"])
    assert df.filter(F.expr(near_dedup._agree("x", "y")) != F.col("want")).count() == 0


@pytest.mark.parametrize("hot_grams", [10_000, 5])
def test_suffix_dedup(spark, sf_small, texts, monkeypatch, hot_grams):
    monkeypatch.setattr(suffix_dedup, "HOT_GRAMS", hot_grams)
    raw = {i: t.encode() for i, t in texts.items()}
    seen = Counter(b[p:p + 200] for b in raw.values() for p in range(len(b) - 199))
    want = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p:p + 200]] > 1:
                gone[p:p + 200] = b"\1" * 200
        left = bytes(c for c, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())
    got = QUERIES["op7_suffix_array_dedup"](spark, sf_small).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(1)
    for _ in range(60):
        runs = [sorted((bytes(rng.choices(b"ab", k=rng.randint(0, 12))), rng.randint(0, 3), 0, 1, 2, 3)
                       for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 9))]
        got = list(suffix_sort.merge([suffix_sort.decode(suffix_sort.encode(r)) for r in runs]))
        assert [(g[1], g[2]) for g in got] == [(e[0], e[1]) for e in sorted(x for r in runs for x in r)]
        assert all(b[0] == suffix_sort.common_prefix(a[1], b[1]) for a, b in zip(got, got[1:]))


def test_fingerprints(spark, sf_small, texts):
    rows = sorted(texts.items())
    after = {rows[i][0]: rows[(i + 1) % len(rows)][1] for i in range(len(rows))}
    cut = lambda t: Counter(p for p in re.split(r"\n+|(?<=[.!?]) +", t) if p)

    def alike(a, b):
        a, b = cut(a), cut(b)
        if a == b:
            return 1.0
        return 2 * sum(a[k] * b[k] for k in a) / (sum(v * v for v in a.values()) + sum(v * v for v in b.values()))
    got = QUERIES["op5_multiset_fingerprint"](spark, sf_small).collect()
    off, prints = [], {}
    for r in got:
        t, n = texts[r.doc_id], len(texts[r.doc_id])
        edited = t[:n - n // 2] + after[r.doc_id][:n // 2]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        off += [abs(r.near_edited - alike(t, edited)), abs(r.near_next - alike(t, after[r.doc_id]))]
        prints.setdefault(r.fingerprint, set()).add(tuple(sorted(cut(t).elements())))
    assert sum(off) / len(off) < 0.08 and max(off) < 0.6
    assert all(len(v) == 1 for v in prints.values()) and len(prints) == len({tuple(sorted(cut(t).elements())) for t in texts.values()})


def test_fingerprint_order_insertion_deletion(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("a\nb\nc", "c\na\nb", "a\nb", "c")], "x string, y string, z string, p string")
    v = {k: fingerprint.vector(F.col(k)) for k in "xyz"}
    r = df.select((v["x"] == v["y"]).alias("order"), (fingerprint.insert(v["z"], F.col("p")) == v["x"]).alias("insert"),
                  (fingerprint.delete(v["x"], F.col("p")) == v["z"]).alias("delete"),
                  (fingerprint.merge(v["z"], fingerprint.vector(F.col("p"))) == v["x"]).alias("merge")).first()
    assert r.order and r.insert and r.delete and r.merge


def test_passages_catch_every_shared_run(spark, sf_small, texts):
    words = {i: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.translate(LOWER)) for i, t in texts.items()}
    where = {}
    for i, w in words.items():
        for j in range(len(w) - 49):
            where.setdefault(tuple(w[j:j + 50]), set()).add(i)
    shared = set().union(*(v for v in where.values() if len(v) > 1))
    got = QUERIES["op4_chained_passages"](spark, sf_small).collect()
    assert shared <= {r.doc_id for r in got} | {r.other_id for r in got}
    for r in got:                                           # every passage is real
        a, b = words[r.doc_id][r.start:r.end], words[r.other_id][r.other_start:r.other_end]
        assert min(len(a), len(b)) >= passages.MIN_WORDS and r.n_equal >= 0.75 * max(len(a), len(b))
        assert sum((Counter(a) & Counter(b)).values()) >= r.n_equal


def test_chains_are_the_best(monkeypatch):
    """Fenwick chaining against the quadratic recurrence."""
    import numpy as np
    rng = random.Random(3)
    for _ in range(40):
        pts = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randint(1, 25))})
        p, q = (np.array(x, np.int64) for x in zip(*pts))
        best = []
        for j, (a, b) in enumerate(pts):
            s = [best[i] - passages.GAP_COST * (a - x + b - y) for i, (x, y) in enumerate(pts[:j]) if x < a and y < b]
            best.append(passages.SEED + max([0, *s]))
        chains = passages.best_chains(p, q)
        assert sorted(i for c in chains for i in c) == list(range(len(pts)))
        assert all((np.diff(p[c]) > 0).all() and (np.diff(q[c]) > 0).all() for c in chains)
        gaps = [max(np.diff(p[c]).max(), np.diff(q[c]).max()) for c in chains if len(c) > 1]
        assert all(g <= passages.MAX_GAP for g in gaps)
        monkeypatch.setattr(passages, "MAX_GAP", 10 ** 9)          # before any cut the first chain is the best one
        chain = passages.best_chains(p, q)[0]
        monkeypatch.undo()
        score = passages.SEED * len(chain) - passages.GAP_COST * sum(
            p[b] - p[a] + q[b] - q[a] for a, b in zip(chain, chain[1:]))
        assert abs(score - max(best)) < 1e-9


def test_a_second_passage_chains_beside_a_long_first_one():
    """However long the first passage is, the seeds of the second chain among themselves."""
    import numpy as np
    for first, gap_p, gap_q, second in ((500, 45, 60, 100), (500, 45, 60, 200), (2000, 50, 70, 400)):
        p = np.concatenate([np.arange(first), first + gap_p + np.arange(second)])
        q = np.concatenate([np.arange(first), first + gap_q + np.arange(second)])
        chains = passages.best_chains(p, q)
        assert sorted(map(len, chains)) == sorted([first, second])


def test_mixing_stays_within_a_block(spark, sf_small):
    docs = table(spark, sf_small, "documents").select("doc_id", "source")
    rows = mixing.mix(docs, block=1, epochs="cover").select("source", "mix.*").collect()
    share, q = {r.source: r.share for r in rows}, rows[0].period
    slots = {r.slot: r.source for r in rows}
    assert len(slots) == len(rows) and all(r.release <= r.slot < r.deadline for r in rows)
    had = Counter()
    for t in range(max(slots) + 1):
        had[slots.get(t)] += 1
        assert all(abs(had[s] - (t + 1) * e / q) < 1 for s, e in share.items())


def test_mixing_with_given_weights(spark):
    docs = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(200)], "doc_id long, source string")
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    rows = mixing.mix(docs, w, block=1).select("doc_id", "source", "mix.*").collect()
    assert {r.share for r in rows} == {512}
    assert len({r.doc_id for r in rows}) == 200 and max(r.epoch for r in rows) == 9


def test_held_out_accuracy(spark, sf_small):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in language_id.report(docs).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in got) >= 0.97 * len(got)
    labels = {r.doc_id: r.toxic for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    got = [r for r in toxicity.report(docs, table(spark, "/root/testdata/sf0.01", "labels")).collect()
           if r.doc_id in labels and r.held_out]
    assert sum(labels[r.doc_id] == r.predicted for r in got) >= 0.9 * len(got)
