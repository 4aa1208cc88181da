"""Toxicity by multiple-instance learning with a noisy-or.

A document is a bag of sentences.  A sentence's score is the logistic of a bias
and the weights of its words and their beginnings; the document's is the noisy-or of its sentences,
1 - prod(1 - s).  Only document labels are needed: the gradient of the noisy-or
moves the blame to the sentences that explain the label, and the fitted
sentence scores locate the offending ones.  The fit has a leak, the chance that
a document is marked although no sentence explains it; it absorbs wrong labels
and is no part of a score.

The fit uses at most `sample_rows` labelled documents (`FIT_ROWS`), half from
each class, picked by a hash of the id, so it costs the same at any size; the
chosen words are the `vocabulary` most associated with the label.  Scoring reads
every whole text in the tasks that scan it, without a shuffle.

Sentences end at . ! ? and line ends.  Words are runs of letters, digits,
apostrophes and non-ASCII characters, A-Z lower-cased.

Defined results: null, empty or wordless text scores 0; a null id is never held
out and never learned from; contradicting label rows count as toxic; without
labelled documents of both classes the model has no words and every score is
the noisy-or of the bias alone (near 0); extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import prepare

FIT_ROWS = 8000           # labelled documents the fit may use
VOCABULARY = 500          # features with a weight
LEAST_DOCS = 5            # sampled documents a feature must occur in
STEPS, RATE, RIDGE = 400, 0.1, 3e-5
START_BIAS, START_LEAK = -7.0, -3.0
NO_MODEL_BIAS = -20.0
PREFIXES = (4, 5, 6, 7, 8)  # bytes

_SEPARATES = np.ones(256, bool)
_SEPARATES[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = False
_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63, 10]] = True


@dataclass
class Model:
    """Sorted feature hashes, their weights and the bias."""
    words: np.ndarray
    weights: np.ndarray
    bias: float


def _sentences(data: np.ndarray, off: np.ndarray):
    """(feature hashes, sentence number of each, text of each sentence, byte
    spans of the sentences); numbers count sentences that have words.  A word's
    features are the word and its beginnings."""
    h, first, ws, begins = tokens.word_hashes(data, off, _SEPARATES, PREFIXES)
    none = np.zeros(0, np.int64)
    if not len(h):
        return h, none, none, none, none
    ends = np.cumsum(_ENDS[data])[ws]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    new = np.ones(len(ws), bool)
    new[1:] = (ends[1:] != ends[:-1]) | (doc[1:] != doc[:-1])
    sent = np.cumsum(new) - 1
    at, text = ws[new], doc[new]
    upto = np.minimum(np.append(at[1:], len(data)), off[text + 1])
    return (np.concatenate([h, *[x for _, x in begins]]), np.concatenate([sent, *[sent[i] for i, _ in begins]]),
            text, at, upto)


def _distinct_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, feature) once per text."""
    for batch in batches:
        label = np.asarray(batch.column(0), dtype=np.int32)
        for a, b, data, off in tokens.pieces(batch.column(1)):
            h, sent, doc, _, _ = _sentences(data, off)
            d = doc[sent]
            for i in range(b - a):
                u = np.unique(h[d == i])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), label[a + i])), pa.array(u.view(np.int64))],
                                                 ["toxic", "feature"])


def _lookup(vocab: np.ndarray):
    """A function from hashes to (indexes of the known ones, their places in the sorted vocabulary)."""
    may = np.zeros(1 << 20, bool)
    may[vocab >> np.uint64(44)] = True

    def find(h):
        at = np.flatnonzero(may[h >> np.uint64(44)])
        place = np.minimum(np.searchsorted(vocab, h[at]), max(len(vocab) - 1, 0))
        ok = vocab[place] == h[at] if len(vocab) else np.zeros(0, bool)
        return at[ok], place[ok]
    return find


def _entries(vocab: np.ndarray):
    """Per labelled text: label, sentences, and the vocabulary's features in them."""
    find = _lookup(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in tokens.pieces(batch.column(1)):
                h, sent, doc, _, _ = _sentences(data, off)
                at, place = find(h)
                first = np.searchsorted(doc, np.arange(b - a + 1))
                d = doc[sent[at]]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(np.diff(first), pa.int64()),
                    pa.array([place[d == i].astype(np.int32).tobytes() for i in range(b - a)], pa.binary()),
                    pa.array([(sent[at][d == i] - first[i]).astype(np.int32).tobytes() for i in range(b - a)], pa.binary())],
                    ["toxic", "n", "words", "sentences"])
    return run


def _learn(vocab: np.ndarray, rows: list) -> Model:
    """Gradient ascent on the noisy-or likelihood of the sampled documents."""
    y = np.array([r.toxic for r in rows], np.float64)
    if not len(vocab) or not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), NO_MODEL_BIAS)
    # one entry per known feature of a sentence; sentences without any share the bias alone
    sentence, word, text, plain, total = [], [], [], np.zeros(len(rows)), 0
    for i, r in enumerate(rows):
        used, number = np.unique(np.frombuffer(r.sentences, np.int32), return_inverse=True)
        sentence.append(number + total)
        word.append(np.frombuffer(r.words, np.int32))
        text.append(np.full(len(used), i))
        plain[i] = r.n - len(used)
        total += len(used)
    sentence, word, text = np.concatenate(sentence), np.concatenate(word), np.concatenate(text)
    params = np.zeros(len(vocab) + 2)                 # weights, bias, logit of the leak
    params[-2:] = START_BIAS, START_LEAK
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        w, bias = params[:-2], params[-2]
        leak = 1 / (1 + np.exp(-params[-1]))
        z = bias + np.bincount(sentence, weights=w[word], minlength=total)
        log_clean = -np.bincount(text, weights=np.logaddexp(0, z), minlength=len(rows)) - plain * np.logaddexp(0, bias)
        unmarked = (1 - leak) * np.exp(log_clean)                 # chance of label 0
        pull = np.where(y == 1, unmarked / np.maximum(1 - unmarked, 1e-9), -1.0) / len(y)
        g_sentence = pull[text] / (1 + np.exp(-z))
        grad = np.empty_like(params)
        grad[:-2] = np.bincount(word, weights=g_sentence[sentence], minlength=len(vocab)) - RIDGE * w
        grad[-2] = g_sentence.sum() + (pull * plain).sum() / (1 + np.exp(-bias))
        grad[-1] = leak * pull.sum()
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad ** 2
        params = params + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Model(vocab, params[:-2], float(params[-2]))


def held_out(doc_id, parts: int = 5, part: int = 0):
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = FIT_ROWS) -> Model:
    """Fit on a bounded sample of the labelled, not held-out documents."""
    prepare(docs.sparkSession)
    known = (labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    picked = None
    for label in (1, 0):
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // 2)
        picked = part if picked is None else picked.union(part)
    # at most sample_rows ids: the broadcast has a proven bound
    sample = (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
              .select("toxic", "text"))
    size, marked = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not size or marked in (0, size):
        return _learn(np.zeros(0, np.uint64), [])
    prior = marked / size
    counts = (sample.mapInArrow(_distinct_features, "toxic int, feature long").groupBy("feature")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits")).filter(F.col("n") >= LEAST_DOCS))
    strength = (F.col("hits") - F.col("n") * prior) / F.sqrt(F.col("n") * prior * (1 - prior))
    chosen = counts.orderBy(strength.desc(), "feature").limit(VOCABULARY).collect()
    vocab = np.sort(np.array([r.feature for r in chosen], np.int64).view(np.uint64))
    rows = sample.mapInArrow(_entries(vocab), "toxic int, n long, words binary, sentences binary").collect()
    return _learn(vocab, rows)


def _score_texts(model: Model, name: str, schema: T.StructType):
    find = _lookup(model.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_type = pa.struct([("score", pa.float64()), ("worst", pa.list_(pa.struct([
            ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])
        for batch in batches:
            for a, b, data, off in tokens.pieces(batch.column(batch.schema.get_field_index("text"))):
                h, sent, doc, begin, upto = _sentences(data, off)
                log_clean = np.zeros(b - a)
                worst: list[list] = [[] for _ in range(b - a)]
                if len(h):
                    at, place = find(h)
                    z = model.bias + np.bincount(sent[at], weights=model.weights[place], minlength=len(doc))
                    log_clean = -np.bincount(doc, weights=np.logaddexp(0, z), minlength=b - a)
                    for s in np.flatnonzero(z >= 0).tolist():
                        base = int(off[doc[s]])
                        worst[doc[s]].append({"start": int(begin[s]) - base, "end": int(upto[s]) - base,
                                              "score": float(1 / (1 + np.exp(-z[s])))})
                result = pa.StructArray.from_arrays(
                    [pa.array(-np.expm1(log_clean)), pa.array(worst, out_type.field("worst").type)], ["score", "sentences"])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, result], [*part.schema.names, name])
    return run


def score(docs: DataFrame, model: Model, out: str = "toxicity") -> DataFrame:
    """`docs` plus the struct column `out`: score, and sentences: byte spans
    [start, end) and scores of the offending sentences (score at least 0.5)."""
    prepare(docs.sparkSession)
    docs = docs.drop(out)
    schema = T.StructType(docs.schema.fields + [T.StructField(out, T._parse_datatype_string(
        "score double, sentences array<struct<start:int,end:int,score:double>>"))])
    return docs.mapInArrow(_score_texts(model, out, schema), schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row per document, and how many sentences offend."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity.score").alias("score"),
                         (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
                         F.col("toxicity.sentences").alias("sentences"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the documents the model rejects."""
    return score(docs, fit(docs, labels), "_tox").filter("_tox.score < 0.5").drop("_tox")
