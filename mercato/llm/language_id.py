"""Language identification by rank-order n-gram profiles.

A profile is a ranking of the most frequent character n-grams (1 to 3 letters,
words bounded by a mark).  A document's profile is compared to each language's
by the out-of-place distance: the sum over the document's n-grams of how far
their ranks lie apart, PROFILE for an n-gram that the language's profile lacks.
The nearest language wins; ties go to the first name.

Profiles are learned from a sample of about `sample_per_language` documents of
each language (FIT_DOCS), picked by a hash of the id, so a rare language is
learned from all it has and the cost of the fit does not grow.  Every whole text
is predicted, in the tasks that scan it, without a shuffle.

Defined results: `und` with score 0 for null text, for text without a letter,
and for every text when nothing could be learned; a null id is not held out and
is learned from; rows with null lang teach nothing; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare
from .tokens import pieces

PROFILE = 400              # n-grams in a profile
GRAMS = 3                  # longest n-gram
FIT_DOCS = 2000            # sampled documents per language, about
EDGE = 1                   # code of the mark between words; letters have codes above, 0 is no letter

_letters: list[np.ndarray] = []


def _letter_codes() -> np.ndarray:
    """Code point -> code point of its lower-case letter, 0 if it is no letter."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def _marked(text: bytes) -> np.ndarray:
    """Codes of the text's letters with one EDGE before, between and after words; empty without letters."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    codes = _letter_codes()[points]
    inside = codes > 0
    if not inside.any():
        return codes[:0]
    keep = inside.copy()
    keep[:-1] |= inside[1:]                 # one mark before each word
    keep[1:] |= inside[:-1]                 # and one after it
    out = np.where(inside, codes, EDGE)[keep]
    out = np.concatenate([[np.uint32(EDGE)], out, [np.uint32(EDGE)]])
    double = np.zeros(len(out), bool)
    double[1:] = (out[1:] == EDGE) & (out[:-1] == EDGE)
    return out[~double].astype(np.uint64)


def _grams(codes: np.ndarray) -> np.ndarray:
    """All n-grams as numbers (21 bits a letter), without the mark alone."""
    out, g = [codes[codes != EDGE]], codes
    for n in range(1, GRAMS):
        g = g[:-1] | (codes[n:] << np.uint64(21 * n))
        out.append(g)
    return np.concatenate(out)


def _top(grams: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent n-grams in rank order; equal counts by number."""
    u, n = np.unique(grams, return_counts=True)
    if len(u) > PROFILE:
        least = np.partition(n, len(n) - PROFILE)[len(n) - PROFILE]
        keep = n >= least
        u, n = u[keep], n[keep]
    return u[np.argsort(-n, kind="stable")][:PROFILE]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for _, _, data, off in pieces(batch.column(column)):
        raw = data.tobytes()
        for x, y in zip(off[:-1].tolist(), off[1:].tolist()):
            yield raw[x:y]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n-gram, count) of each batch."""
    for batch in batches:
        by_lang: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
            by_lang.setdefault(lang, []).append(_grams(_marked(text)))
        for lang, grams in by_lang.items():
            u, n = np.unique(np.concatenate(grams), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(n)],
                                             ["lang", "gram", "n"])


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def fit(docs: DataFrame, sample_per_language: int = FIT_DOCS) -> dict[str, np.ndarray]:
    """language -> its profile (n-grams in rank order), from documents that are not held out."""
    prepare(docs.sparkSession)
    known = docs.filter("lang is not null").filter(~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    share = F.least(F.lit(1.0), F.lit(float(sample_per_language)) / F.col("_n"))
    # one row per language
    sample = (known.select("lang", "text", F.xxhash64("doc_id").alias("_h"))
              .join(F.broadcast(sizes.select("lang", (share * 2.0**20).alias("_below"))), "lang")
              .filter(F.pmod("_h", F.lit(1 << 20)) < F.col("_below")))
    counts = (sample.select("lang", "text").mapInArrow(_counts, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    rows = counts.withColumn("rank", rank).filter(F.col("rank") <= PROFILE).select("lang", "gram", "rank").collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.rank)):
        out.setdefault(r.lang, []).append(r.gram)
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in out.items()}


def _predict(profiles: dict[str, np.ndarray], schema: T.StructType, name: str):
    langs = sorted(profiles)
    vocab = np.unique(np.concatenate([profiles[k] for k in langs])) if langs else np.zeros(0, np.uint64)
    ranks = np.full((len(vocab) + 1, max(len(langs), 1)), -1, np.int64)        # the last row: in no profile
    for j, k in enumerate(langs):
        ranks[np.searchsorted(vocab, profiles[k]), j] = np.arange(len(profiles[k]))

    def one(text: bytes) -> tuple[str, float]:
        codes = _marked(text)
        if not len(codes) or not langs:
            return "und", 0.0
        top = _top(_grams(codes))
        at = np.minimum(np.searchsorted(vocab, top), len(vocab) - 1)
        theirs = ranks[np.where(vocab[at] == top, at, len(vocab))]
        apart = np.where(theirs < 0, PROFILE, np.abs(theirs - np.arange(len(top))[:, None])).sum(0)
        best = int(apart.argmin())
        return langs[best], 1.0 - float(apart[best]) / (PROFILE * len(top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t) for t in _texts(batch, batch.schema.get_field_index("text"))]
            result = pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                                ["lang", "score"])
            yield pa.RecordBatch.from_arrays([*batch.columns, result], [*batch.schema.names, name])
    return run


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], out: str = "language") -> DataFrame:
    """`docs` plus the struct column `out`: lang, score (1 less the mean distance over the largest)."""
    prepare(docs.sparkSession)
    docs = docs.drop(out)
    schema = T.StructType(docs.schema.fields + [T.StructField(out, T._parse_datatype_string("lang string, score double"))])
    return docs.mapInArrow(_predict(profiles, schema, out), schema)


def report(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    p = predict(docs.select("doc_id", "text"), fit(docs))
    return p.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"),
                    F.col("language.score").alias("score"))
