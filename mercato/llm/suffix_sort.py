"""Front-coded sorted runs and a loser tree that knows common prefixes.

A run is a sorted list of entries (key bytes, right length, payload); it travels
front-coded: each key as the length it shares with its predecessor and the rest.
Merging compares two heads by the prefix each shares with the last key that came
out; only when both share equally much are bytes compared, from there on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CODEC = "zstd"


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, given that the first `at` bytes agree."""
    most = min(len(a), len(b))
    while at < most:
        end = min(at + 48, most)
        x, y = a[at:end], b[at:end]
        if x != y:
            gap = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return end - (gap.bit_length() + 7) // 8
        at = end
    return most


def encode(entries: list[tuple[bytes, int, int, int, int, int]]) -> bytes:
    """A sorted run of (key, right length, many, row key 1, row key 2, place)."""
    n = len(entries)
    lcp = np.zeros(n, np.uint16)
    rest, prev = [], b""
    for i, e in enumerate(entries):
        shared = common_prefix(prev, e[0])
        lcp[i] = shared
        rest.append(e[0][shared:])
        prev = e[0]
    columns = [lcp, np.array([len(r) for r in rest], np.uint16), np.array([e[1] for e in entries], np.uint16),
               np.array([e[2] for e in entries], np.uint8)]
    columns += [np.array([e[i] for e in entries], np.int64) for i in (3, 4, 5)]
    raw = b"".join([np.int64(n).tobytes(), *[c.tobytes() for c in columns], *rest])
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec=CODEC, asbytes=True)


def decode(block: bytes) -> Iterator[tuple[int, bytes, int, int, int, int, int]]:
    """(prefix shared with the predecessor, key, right length, many, row key 1, row key 2, place)."""
    raw = pa.decompress(block[8:], int(np.frombuffer(block[:8], np.int64)[0]), codec=CODEC, asbytes=True)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    at, columns = 8, []
    for kind in (np.uint16, np.uint16, np.uint16, np.uint8, np.int64, np.int64, np.int64):
        size = n * np.dtype(kind).itemsize
        columns.append(np.frombuffer(raw[at:at + size], kind).tolist())
        at += size
    key = b""
    for shared, length, right, many, k1, k2, place in zip(*columns):
        key = key[:shared] + raw[at:at + length]
        at += length
        yield shared, key, right, many, k1, k2, place


def merge(runs: list[Iterator]) -> Iterator[tuple[int, bytes, int, int, int, int, int]]:
    """All entries of sorted runs in order, each with the prefix it shares with
    the entry before it (a tournament of losers)."""
    heads = [next(r, None) for r in runs]
    k = len(runs)
    if k == 1:
        while heads[0] is not None:
            yield heads[0]
            heads[0] = next(runs[0], None)
        return
    shared = [0] * k                    # prefix each head shares with the last entry that came out
    losers = [-1] * k

    def beats(i: int, j: int) -> bool:
        """Whether head i comes before head j; the loser learns its prefix with the winner."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return b is None
        if shared[i] != shared[j]:
            return shared[i] > shared[j]
        x, y = a[1], b[1]
        m = common_prefix(x, y, shared[i])
        if m < len(x) and m < len(y):
            first = x[m] < y[m]
        else:
            first = (len(x), a[2]) <= (len(y), b[2])
        shared[j if first else i] = m
        return first

    def settle(i: int) -> int:
        """Play head i up from its leaf; returns the overall winner."""
        node = (i + k) >> 1
        while node:
            if losers[node] < 0:
                losers[node] = i
                return -1
            if not beats(i, losers[node]):
                i, losers[node] = losers[node], i
            node >>= 1
        return i

    winner = -1
    for i in range(k):
        winner = settle(i)
    while heads[winner] is not None:
        out = heads[winner]
        yield (shared[winner], *out[1:])
        heads[winner] = nxt = next(runs[winner], None)
        if nxt is not None:
            shared[winner] = nxt[0]
        winner = settle(winner)
