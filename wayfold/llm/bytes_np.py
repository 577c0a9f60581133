"""Vectorised work on the UTF-8 bytes of Arrow string batches; memory is bounded by CHUNK bytes of text and one long text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the published splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sums(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of the given sizes (0 for an empty one), modulo 2 ** 64."""
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, dtype=np.uint64, out=total[1:])
    ends = np.cumsum(count)
    return total[ends] - total[ends - count]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; null texts are empty."""
    column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(at: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `size` bytes each."""
    i, n = 0, len(at) - 1
    while i < n:
        j = int(np.searchsorted(at, at[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_B = 0xD6E8FEB86659FD93
_BI = pow(_B, -1, 1 << 64)


_KNOWN: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    p = _KNOWN.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, 2 * CHUNK), np.uint64(base))
        p[0] = 1
        p = _KNOWN[base] = np.multiply.accumulate(p)
    return p[:n]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without white space 0x20, 0x09-0x0D; A-Z lowered) and n + 1 offsets by text.

    A text of more than two chunks, which stands alone in its call, is hashed in parts that end at white space.
    """
    if len(at) == 2 and len(data) > 2 * CHUNK:
        parts, i = [], 0
        while i < len(data):
            j = min(i + CHUNK, len(data))
            while j < len(data) and not _SEP[data[j]]:
                j += 1
            parts.append(_words(data[i:j], np.array([0, j - i]))[0])
            i = j
        h = np.concatenate(parts)
        return h, np.array([0, len(h)])
    return _words(data, at)


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    low = _LOW[data]
    inside = ~_SEP[low]
    begins, ends = inside.copy(), inside.copy()
    cut = at[(at > 0) & (at < len(data))]
    begins[1:] &= ~inside[:-1]
    begins[cut] = inside[cut]
    ends[:-1] &= ~inside[1:]
    ends[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[low] * _powers(_B, len(data)), out=total[1:])
    h = (total[e] - total[s]) * _powers(_BI, len(data))[s]
    return mix(h + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.searchsorted(s, at).astype(np.int64)


def shingles(h: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-word shingles by text: (hash, text number), sorted by text and hash, and counts by text.

    A text of fewer than k words, but at least one, has its whole word sequence as its only shingle.
    """
    n, count = len(at) - 1, np.diff(at)
    acc = np.zeros(len(h), np.uint64)
    for i in range(k):
        part = mix(h + np.uint64(i * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        acc[: len(h) - i] += part[i:] if i else part
    own = np.repeat(np.arange(n), count)
    ok = np.arange(len(h)) + k <= at[1:][own] if len(h) else np.zeros(0, bool)
    x, of = mix(acc[ok]), own[ok]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = [np.sum(mix(h[at[i] : at[i + 1]] + (np.arange(count[i], dtype=np.uint64) + np.uint64(17)) * np.uint64(0xD1B54A32D192ED03)), dtype=np.uint64) for i in short]
        x, of = np.concatenate([x, mix(np.array(whole, np.uint64) + count[short].astype(np.uint64))]), np.concatenate([of, short])
    order = np.lexsort((x, of))
    x, of = x[order], of[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (of[1:] != of[:-1])
    x, of = x[new], of[new]
    return x, of, np.bincount(of, minlength=n).astype(np.int64)
