"""Importance resampling against plain Python; the cutoff search; edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercato.llm import importance

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def buckets(text):
    w = words(text)
    return [zlib.crc32(b" ".join(w[i:i + n])) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text))
    for text in target:
        t.update(buckets(text))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for i, text in docs:
        f = buckets(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, len(words(text)), len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    may = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[:5 * len(may) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


LONG = "word0, Ünïcödé " * 120_000 + "漢字" * 40_000 + " end"                 # above a piece, a chunk of words and a short word


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(8)
    pool = [f"w{i}" for i in range(60)] + ["Exam", "question", "Answer", "é", "x" * 70, "y" * 49, "z" * 48]
    rows = [(i, " ".join(rnd.choices(pool, k=rnd.randrange(0, 60)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "...\n!"), (1003, "One"), (1004, "one two"), (1005, LONG), (None, "exam question answer " * 9),
             (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return rows, df.withColumns({c: F.lit(1) for c in ("score", "row", "rank", "weight", "n", "side", "bucket", "size", "n_words")}).repartition(6)


TARGET = ["The exam question: answer it.", None, "", "Exam question answer w1 w2", "one"]


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")


@pytest.mark.parametrize("finish", (1, 256))
def test_equals_plain_python(docs, target, finish):
    rows, df = docs
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank"))
                  for r in importance.draw(df, target, finish=finish).collect()), key=str)
    assert got == brute(rows, TARGET)


def test_crc_of_runs():
    texts = ["a bb, ccc; " + "d" * 200 + " e", "", "one", "\x7f\x01", "é é " + "x" * 20_000 + " z"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    data, ws, we, first = importance.words(raw, off)
    crc = importance.features(data, ws, we)
    for i, t in enumerate(texts):
        w = words(t)
        assert first[i + 1] - first[i] == len(w)
        for n in (1, 2, 3):
            for j in range(n - 1, len(w)):
                assert crc[n - 1][first[i] + j] == zlib.crc32(b" ".join(w[j - n + 1:j + 1]))


def test_cutoff_finds_every_key_among_ties(spark):
    rnd = random.Random(9)
    rows = [(rnd.randrange(4) if i % 3 else 2, rnd.choice([None, 1, 2, 3]), i) for i in range(120)]     # a third of one score
    df = spark.createDataFrame(rows, "score long, doc_id long, row long").repartition(5)
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    for k in (1, 2, 17, 60, 119, 120):
        assert importance.cutoff(df, k, finish=1) == order[k - 1]
    assert importance.cutoff(df, 0) is None and importance.cutoff(df, 121) is None and importance.cutoff(df.limit(0), 1) is None


def test_text_ids_and_empty_tables(spark, docs, target):
    _, df = docs
    named = df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    got = importance.draw(named, target, finish=1).filter("rank is not null").orderBy("rank").collect()
    may = sum(len(words(t)) >= 20 for _, t in docs[0])
    assert [r["rank"] for r in got] == list(range(1, 5 * may // 100 + 1))
    assert all((a.score, b.doc_id) >= (b.score, a.doc_id) for a, b in zip(got, got[1:]))
    assert importance.draw(df.limit(0), target).count() == 0
    assert importance.draw(df, target.limit(0)).count() == df.count()
