"""Vectorised hashing of words and shingles, straight from Arrow's UTF-8 buffers.

White space is the six ASCII characters U+0009-U+000D and U+0020, so that words can be cut on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once; a longer text is a chunk of its own.
CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK)
        up, down = np.full(size, _BASE), np.full(size, _INV)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls become empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def chunks(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows with about CHUNK bytes together."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts data[off[i]:off[i+1]], and where each text's words begin (len(off) entries)."""
    base, end = int(off[0]), int(off[-1])
    b = data[base:end]
    n = len(b)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64)
    ink = ~_SPACE[b]
    edge = np.zeros(n + 1, bool)
    edge[(off - base)] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:n]
    last = ink
    last = last.copy()
    last[:-1] &= ~ink[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTE)[b] * up[:n], out=sums[1:])
    h = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
    return h, np.searchsorted(s, off - base)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text; all its words as one if they are fewer."""
    if not len(words):
        return np.empty(0, np.uint64)
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.full(n, np.uint64(0x51ED270B0000 + k))
    for j in range(k):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + words[j : j + n])
    return np.unique(h)
