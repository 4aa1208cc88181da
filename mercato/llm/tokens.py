"""Vectorised text kernels over Arrow string arrays, used inside Spark tasks.

Texts are read straight from the Arrow buffers (UTF-8 bytes) in pieces of a few
megabytes, so the working memory does not depend on the batch size; only a
single text longer than a piece needs more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 2 << 20          # bytes of text handled at once
_RNG = np.random.Generator(np.random.PCG64(20240229))     # fixed: every task draws the same constants
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_COMBINE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWERED = _BYTE.copy()
_LOWERED[65:91] = _BYTE[97:123]     # A-Z count as a-z


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows
    that hold about PIECE bytes; null texts are empty."""
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.large_string())
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + PIECE, "right")) - 1)
        yield at, end, raw[off[at]:off[end]], off[at:end + 1] - off[at]
        at = end


def word_hashes(data: np.ndarray, off: np.ndarray, separates: np.ndarray = BLANK,
                prefixes: tuple[int, ...] = ()) -> tuple:
    """Words are runs of bytes that do not separate, A-Z lower-cased, within one text.

    Returns (64-bit hash per word, first word index per text plus the total,
    byte position where each word starts); with `prefixes` also a list with, per
    length, (indexes of the longer words, hashes of their first bytes)."""
    n = len(data)
    empty = (np.zeros(0, np.uint64), np.zeros(len(off), np.int64), np.zeros(0, np.int64))
    none = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))] * len(prefixes)
    if not n:
        return (*empty, none) if prefixes else empty
    blank = separates[data]
    start = ~blank
    start[1:] &= blank[:-1]
    firsts = off[:-1][off[:-1] < n]
    start[firsts] = ~blank[firsts]
    ws = np.flatnonzero(start)
    if not len(ws):
        return (*empty, none) if prefixes else empty
    span = np.diff(np.append(ws, n))
    pos = np.arange(ws[0], n) - np.repeat(ws, span)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(span.max()), _STEP)]))
    # a word's span may run over blanks, which count nothing; the next word, of any text, starts a new one
    value = np.where(separates, np.uint64(0), _LOWERED)[data[ws[0]:]] * power[pos]
    h = mix(np.add.reduceat(value, ws - ws[0]))
    first = np.searchsorted(ws, off)
    if not prefixes:
        return h, first, ws
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    length = np.add.reduceat(~blank[ws[0]:], ws - ws[0], dtype=np.int64)
    out = []
    for k in prefixes:
        long = np.flatnonzero(length > k)
        at = ws[long] - ws[0]
        out.append((long, mix(sums[at + k] - sums[at] + _COMBINE[k])))
    return h, first, ws, out


def shingle_sets(words: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; a text of
    1..k-1 words has its whole sequence as one, a text without words none."""
    n = len(words)
    if n >= k:
        sh = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            sh += words[j:n - k + 1 + j] * _COMBINE[j]
        sh = mix(sh)
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(sh[a:b - k + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _COMBINE[:b - a]).sum(keepdims=True, dtype=np.uint64)
                           + _COMBINE[k + b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
