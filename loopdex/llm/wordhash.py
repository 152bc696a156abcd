"""Vectorised word hashing: 64-bit hashes of the words of many texts at once, straight from Arrow buffers."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INV = _U(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def chunks(texts, max_bytes: int = 2 << 20):
    """Split an Arrow string array into slices of about max_bytes (one text at least), yielding
    (first row, bytes, offsets); nulls are empty."""
    import pyarrow as pa

    arr = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    arr = arr.fill_null("")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(arr):
        j = int(np.searchsorted(offs, offs[i] + max_bytes, side="right")) - 1
        j = min(max(j, i + 1), len(arr))
        yield i, data[offs[i] : offs[j]], (offs[i : j + 1] - offs[i])
        i = j


_TABLE = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept for later calls up to 2 million."""
    if len(_TABLE[0]) >= n:
        return _TABLE[0][:n], _TABLE[1][:n]
    out = []
    for factor in (_BASE, _INV):
        x = np.full(n, factor, dtype=np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, out=x))
    if n <= 2 << 20:
        _TABLE[:] = out
    return out[0], out[1]


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, first word index of each text plus the total)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    low = _LOWER[data]
    solid = ~_IS_SPACE[low]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = offs[:-1][offs[:-1] < offs[1:]]
    begins[first] |= solid[first]
    start = np.flatnonzero(begins)
    ends = np.zeros(n + 1, dtype=bool)
    ends[1:n] = solid[:-1] & (~solid[1:] | begins[1:])
    ends[n] = solid[n - 1]
    end = np.flatnonzero(ends)
    power, inverse = _powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[low] * power, out=total[1:])
    # The sum over a word, moved to offset zero by the inverse power of its start.
    value = (total[end] - total[start]) * inverse[start]
    return mix(value + (end - start).astype(np.uint64)), np.searchsorted(start, offs)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words (position i: words i .. i + width - 1); len(words) - width + 1 values."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = (out ^ words[k : k + n]) * _U(0x9FB21C651E98DF25) + _U(k + 1)
        out ^= out >> _U(29)
    return mix(out)
