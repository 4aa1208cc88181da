"""What the pipeline leaves, against plain Python."""

import re
from collections import Counter

import corpus_pipeline
from mercato.llm import near_dedup, suffix_dedup, toxicity
from mercato.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_cut_texts_keeps_real_replacement_characters(spark):
    """Only bytes that a cut made invalid go."""
    same = "é" * 120
    rows = [(1, "A\ufffdB" + same + "left \ufffd\ufffd"), (2, "C" + same), (3, "\ufffd alone"),
            (4, "x" + "è" + "y" * 250 + "z\ufffd"), (5, "w" + "è" + "y" * 250)]
    out = {r.doc_id: r.text for r in suffix_dedup.cut_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "A\ufffdBleft \ufffd\ufffd", 2: "C", 3: "\ufffd alone", 4: "xz\ufffd", 5: "w"}


def test_cut_texts_drops_broken_characters_only(spark):
    """ũ (c5 a9) and é (c3 a9): the repeated bytes start in the middle of a character."""
    rows = [(1, "\ufffda" + "ũ" + "k" * 210 + "\ufffd"), (2, "b" + "é" + "k" * 210)]
    out = {r.doc_id: r.text for r in suffix_dedup.cut_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "\ufffda\ufffd", 2: "b"}


def _after_near_dedup(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: t for i, t in texts.items() if root(i) == i}


def _after_suffix_dedup(texts):
    raw = {i: t.encode() for i, t in texts.items()}
    seen = Counter(b[p:p + 200] for b in raw.values() for p in range(len(b) - 199))
    left = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p:p + 200]] > 1:
                gone[p:p + 200] = b"\1" * 200
        if b and all(gone):
            continue
        left[i] = "".join(b[m.start():m.end()].decode("utf-8", "ignore") for m in re.finditer(b"\0+", bytes(gone)))
    return left


def _after_decontamination(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    windows = set()
    for t in items:
        w = words(t)
        n = min(13, len(w))
        windows |= {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if n else set()
    left = {}
    for i, t in texts.items():
        w = words(t)
        hit = {k for n in {len(x) for x in windows} for j in range(len(w) - n + 1) if tuple(w[j:j + n]) in windows
               for k in range(j, j + n)}
        if not hit or 20 * len(hit) < len(w):
            left[i] = t
    return left


def test_pipeline_against_brute_force(spark, sf_small):
    """The ids and texts that must be left; the toxicity scores are the operator's (a trained model)."""
    docs = table(spark, sf_small, "documents")
    clean = {r.doc_id for r in toxicity.report(docs, table(spark, sf_small, "labels")).collect() if r.score < 0.5}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    stages = [{i: t for i, t in texts.items() if i in clean}]
    stages.append(_after_near_dedup(stages[-1]))
    stages.append(_after_suffix_dedup(stages[-1]))
    stages.append(_after_decontamination(stages[-1], [r.text or "" for r in table(spark, sf_small, "benchmark").collect()]))
    got = {r.doc_id: r.text for r in corpus_pipeline.run(spark, sf_small).collect()}
    assert got == stages[-1] and len(texts) > len(stages[0]) > len(stages[1]) > len(stages[3]) > 0
    assert any(stages[2][i] != stages[1][i] for i in stages[2])


def test_repeated_rows_keep_one_each(spark):
    """Rows repeated in id and text, copies, near copies and near texts under one id:
    every group is left once, and suffix dedup then finds nothing of it repeated."""
    text = " ".join(f"word{i}" for i in range(120))
    near = text.replace("word60 ", "other ")
    alone = " ".join(f"lone{i}" for i in range(90))
    rows = [(1, text, 1), (1, text, 1), (2, text + " ", 2), (3, text + " ", 3), (5, near, 4), (5, near, 5), (6, alone, 6), (6, alone, 6),
            (7, alone, 7), (8, "same id", 8), (8, "another text here", 9), (8, "same id", 10), (9, None, 11), (9, None, 11), (None, "no id", 12), (None, "no id", 12),
            (10, " ".join(f"x{i}" for i in range(100)), 13), (10, " ".join(f"x{i}" for i in range(99)), 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(4)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    ten = [g for g in got if g[0] == 10]
    assert len(ten) == 1 and ten[0][1] in (rows[16][1], rows[17][1])
    want = [(1, text), (6, alone), (8, "same id"), (8, "another text here"), (9, None), (9, None), (None, "no id"), (None, "no id"), ten[0]]
    assert got == sorted(want, key=str)
    left = sorted(((r.doc_id, r.text) for r in suffix_dedup.cut_texts(kept).collect()), key=str)
    assert left == got
