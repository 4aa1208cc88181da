"""SimHash fingerprints and links against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mercato.llm import simhash

LONG = " ".join(f"Word{i % 977} is{i % 13}" for i in range(300_000))          # above a piece and a chunk


def fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_links(fps):
    fps = np.array(sorted(set(fps)), np.uint64)
    out = set()
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 3)
        out |= {(int(fps[i]), int(fps[i + 1 + j])) for j in near}
    return out


def brute_components(rows):
    """Per (id, fingerprint) the smallest id reachable."""
    root = {f: f for _, f in rows}
    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x
    for a, b in brute_links(root):
        root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [least.get(find(f)) for _, f in rows]


def signed(f):
    return f - 2**64 if f >= 2**63 else f


def flipped(f, *bits):
    for b in bits:
        f ^= 1 << b
    return f


@pytest.fixture(scope="module")
def clustered():
    """Fingerprints around centres at every distance to 6, some bits constant, some
    moving together, one crowded value shared by a third of them."""
    rnd = random.Random(5)
    out = []
    for _ in range(150):
        c = rnd.getrandbits(64)
        out += [flipped(c, *rnd.sample(range(64), k)) for k in range(7)]
    crowd = rnd.getrandbits(40) << 24
    out += [crowd | rnd.getrandbits(24) for _ in range(500)]
    out += [(1 << 60) - 1 ^ (rnd.getrandbits(6) << 20) for _ in range(40)] + [0, 1, 2**64 - 1, 2**63]
    return sorted(set(out))


@pytest.mark.parametrize("plan", (None, *simhash.PLANS, (3, 1), (1, 2, 1)))
def test_links_equal_brute_force(spark, clustered, plan):
    df = spark.createDataFrame([(signed(f),) for f in clustered], "fp long").repartition(4)
    got = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, plan).collect()]
    assert len(got) == len(set(got))
    want = brute_links(clustered)
    assert {tuple(sorted(p)) for p in got} == want and len(want) > 900


def test_deal_is_the_cheapest():
    rnd = np.random.default_rng(3)
    cost = rnd.random((200, 4, simhash.MOST + 2)).cumsum(2)
    cost[:, :, 0] = 0
    units, total = simhash.deal(cost)
    assert (units.sum(1) == simhash.MOST + 1).all()
    every = [(a, b, c, 4 - a - b - c) for a in range(5) for b in range(5 - a) for c in range(5 - a - b)]
    least = np.min([sum(cost[:, i, u] for i, u in enumerate(e)) for e in every], 0)
    assert np.allclose(total, least) and np.allclose(total, sum(cost[np.arange(200), i, units[:, i]] for i in range(4)))


def test_rings_count_neighbours():
    rnd = np.random.default_rng(4)
    values = rnd.integers(0, 1 << 16, 300)
    ring = simhash.rings(np.bincount(values, minlength=1 << 16)[None, :])
    for v in values[:20]:
        d = np.bitwise_count(values ^ v)
        assert [ring[0, k, v] for k in range(4)] == [(d == k).sum() for k in range(4)]


def test_bits_that_move_together_share_a_group(spark):
    rnd = random.Random(6)
    rows = []
    for _ in range(400):
        f = rnd.getrandbits(64)
        if rnd.random() < 0.5:                                                  # bits 0, 4, 8, ... all set or all clear
            f |= int("1" * 16, 16)
        else:
            f &= ~int("1" * 16, 16)
        rows.append((signed(f),))
    groups = simhash.grouped_bits(spark.createDataFrame(rows, "fp long"))
    assert sorted(groups.ravel()) == list(range(64))
    assert list(range(0, 64, 4)) in groups.tolist()


def test_report_equals_brute_force(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choices(vocabulary, k=400)) for _ in range(25)]
    texts = [None, "", " \t\n ", "One", "one", "ONE two", "One  two\x0bTHREE", "one two three", "é Ünï ß", "x y z", LONG, LONG]
    for b in base:
        w = b.split()
        texts += [b, b.upper(), b.replace(" ", "\n")]
        for _ in range(4):
            w = list(w)
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, base[0]), (None, "alone without an id"), (3, "One"), (3, "Other text of the same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("fp", "a", "b", "key", "first", "comp", "component_id")})
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.report(df.repartition(3)).collect()), key=str)
    fps = [(i, fingerprint(t)) for i, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(fps, brute_components(fps))), key=str)
    assert got == want
    assert brute_links([f for _, f in fps]) and any(c is None for _, _, c in want)
    kept = [r.doc_id for r in simhash.keep_one(df).collect()]
    assert sorted(kept) == sorted({c for _, _, c in want if c is not None})


def test_given_documents_and_empty_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.report(docs).collect()}
    fps = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    assert got == {i: (f"{f:016x}", c) for (i, f), c in zip(fps, brute_components(fps))}
    assert simhash.report(docs.limit(0)).count() == 0
