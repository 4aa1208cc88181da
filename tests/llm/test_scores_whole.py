"""Every row's language and toxicity against plain Python over the fitted models."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercato.llm import language_id, toxicity
from mercato.llm.common import table


def _profile(text):
    """The n-grams of 1 to 3 letters, most frequent first; words stand between marks."""
    out, word = Counter(), ""
    marked = "_"
    for ch in text or "":
        if ch.isalpha():
            low = ch.lower()
            word += low if len(low) == 1 else ch
        elif word:
            marked, word = marked + word + "_", ""
    marked += word + "_" if word else ""
    number = [language_id.EDGE if c == "_" else ord(c) for c in marked]
    for i in range(len(number)):
        for n in (1, 2, 3):
            gram = number[i:i + n]
            if len(gram) == n and gram != [language_id.EDGE]:
                out[sum(c << (21 * j) for j, c in enumerate(gram))] += 1
    return [g for g, _ in sorted(out.items(), key=lambda x: (-x[1], x[0]))[:language_id.PROFILE]]


def _language(text, profiles):
    mine = _profile(text)
    if not mine or not profiles:
        return "und", 0.0
    apart = {}
    for lang in sorted(profiles):
        place = {int(g): r for r, g in enumerate(profiles[lang])}
        apart[lang] = sum(abs(place[g] - r) if g in place else language_id.PROFILE for r, g in enumerate(mine))
    best = min(sorted(apart), key=apart.get)
    return best, 1 - apart[best] / (language_id.PROFILE * len(mine))


def test_language_of_every_row(spark, sf_small):
    docs = table(spark, sf_small, "documents").select("doc_id", "text", "lang")
    profiles = language_id.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.report(docs).collect()}
    for r in docs.collect():
        lang, score = _language(r.text, profiles)
        assert got[r.doc_id] == (lang, pytest.approx(score, abs=1e-12)), r.doc_id


def test_equal_profiles_go_to_the_first_name(spark):
    profile = np.array(_profile("der hund und die katze"), np.int64).view(np.uint64)
    docs = spark.createDataFrame([(1, "der hund"), (2, None), (3, "12 !"), (4, "ß İ ǅ")], "doc_id long, text string")
    got = {r.doc_id: r.language.lang for r in language_id.predict(docs, {"b": profile, "a": profile}).collect()}
    assert got == {1: "a", 2: "und", 3: "und", 4: "a"}


def test_held_out_languages_teach_nothing(spark, sf_small):
    docs = table(spark, sf_small, "documents").select("doc_id", "text", "lang")
    lied = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert sorted(language_id.report(docs).collect()) == sorted(language_id.report(lied).collect())


def _toxicity(text, model):
    """Noisy-or over the sentences that have words, one at a time."""
    weight = dict(zip(model.words.tolist(), model.weights.tolist()))
    data = np.frombuffer((text or "").encode(), np.uint8)
    h, sent, doc, _, _ = toxicity._sentences(data, np.array([0, len(data)]))
    known = Counter()
    for feature, s in zip(h.tolist(), sent.tolist()):
        known[s] += weight.get(feature, 0.0)
    clean = 1.0
    for s in range(len(doc)):
        clean *= 1 - 1 / (1 + math.exp(-(model.bias + known[s])))
    return 1 - clean


def test_toxicity_of_every_row(spark, sf_small):
    docs, labels = table(spark, sf_small, "documents"), table(spark, sf_small, "labels")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    for r in docs.select("doc_id", "text").collect():
        want = _toxicity(r.text, model)
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-9), r.doc_id
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)


def test_repeated_rows_and_held_out_labels(spark, sf_small):
    docs = table(spark, sf_small, "documents").select("doc_id", "text")
    labels = table(spark, sf_small, "labels")
    lied = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = toxicity.report(docs, labels).select("doc_id", "score")
    two = toxicity.report(docs.union(docs), lied).select("doc_id", "score")
    assert sorted(one.union(one).collect()) == sorted(two.collect())
