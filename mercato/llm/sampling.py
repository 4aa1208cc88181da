"""Content-defined sampling of text positions.

Every window of WIDTH bytes gets the position of the smallest K-gram hash in it
(the leftmost one on ties).  The choice depends on the window's bytes alone, so
equal windows choose the same place within themselves.  Neighbouring windows
mostly share their choice, which makes one record per run of windows."""

from __future__ import annotations

import numpy as np

from .tokens import _BYTE, mix

WIDTH = 200
GRAM = 80
_MOST = 1 << 20                      # segment length: positions take 21 bits of a sort key
_STEP = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    if which not in _powers or len(_powers[which]) < n:
        base = _STEP if which == "up" else _INVERSE
        _powers[which] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 16), base)]))
    return _powers[which]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams of the bytes (len - k + 1 of them)."""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", n)[:n], out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * _power("down", n)[:n - k + 1])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def _segment(data: np.ndarray, width: int, k: int):
    h = gram_hashes(data, k)
    key = (h & ~np.uint64((1 << 21) - 1)) | np.arange(len(h), dtype=np.uint64)
    at = (_sliding_min(key, width - k + 1) & np.uint64((1 << 21) - 1)).astype(np.int64)
    return h, at


def runs(data: np.ndarray, off: np.ndarray, width: int = WIDTH, k: int = GRAM):
    """Per run of windows with one chosen position: (text index, chosen position,
    first window, last window, 64-bit hash of the gram there); positions count
    from the text's start.  Windows never cross texts.  Texts longer than a
    segment are cut into segments that overlap by width - 1 bytes."""
    parts = []
    n = len(data)
    for s in range(0, max(n - width + 1, 0), _MOST):
        e = min(n, s + _MOST + width - 1)
        if e - s < width:
            continue
        h, at = _segment(data[s:e], width, k)
        p = np.arange(s, s + len(at))
        doc = np.searchsorted(off, p, "right") - 1
        ok = p + width <= off[doc + 1]
        new = np.ones(len(p), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~ok[:-1]
        first = np.flatnonzero(new & ok)
        if not len(first):
            continue
        ends = np.append(first[1:], len(p))
        # the last valid window of each run: invalid windows follow the valid ones of their text
        valid = np.cumsum(ok)
        last = first + (valid[ends - 1] - valid[first])
        d = doc[first]
        parts.append((d, at[first] + s - off[d], p[first] - off[d], p[last] - off[d], h[at[first]]))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))
