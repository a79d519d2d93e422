"""Vectorised word and shingle hashing over UTF-8 buffers.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z
lower-cased. A whole Arrow batch is hashed at once: a prefix sum of
``byte * base**i`` (modulo 2**64) gives every word's hash as a difference of
two prefixes, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text hashed together; a longer document is hashed alone.
SLICE_BYTES = 1 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, base, U)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=U))
        _powers[:] = tables
    return _powers


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together (one row at least)."""
    first, rows = 0, len(at) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, last
        first = last


def words_of(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of consecutive texts, and each text's range of words.

    ``at`` holds the texts' byte offsets in ``data``; the second result has the
    same length and holds offsets into the first.
    """
    b, at = data[at[0] : at[-1]], at - at[0]
    n = len(b)
    if not n:
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    if lower:
        b = _LOWER[b]
    white = _WS[b]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = white[:-1], white[1:]
    edges = at[(at > 0) & (at < n)]
    before[edges] = True
    after[edges - 1] = True
    start = np.flatnonzero(~white & before)
    end = np.flatnonzero(~white & after) + 1
    power, inverse = _power_tables(n + 1)
    prefix = np.zeros(n + 1, U)
    np.cumsum((b.astype(U) + U(1)) * power[:n], out=prefix[1:])
    value = (prefix[end] - prefix[start]) * inverse[start]
    return mix(value ^ ((end - start).astype(U) << U(48))), np.searchsorted(start, at)


def shingles_of(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles of each text, and their ranges.

    A text of 1 to ``k`` - 1 words has its whole sequence as one shingle; a
    text without words has none.
    """
    counts = np.diff(at)
    have = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    to = np.concatenate(([0], np.cumsum(have)))
    if not to[-1]:
        return np.zeros(0, U), to
    n = len(words)
    factor = mix(np.arange(1, k + 1, dtype=U) * U(_BASE)) | U(1)
    total = np.zeros(n, U)
    for j in range(min(k, n)):
        total[: n - j] += words[j:] * factor[j]
    first = np.repeat(at[:-1] - to[:-1], have) + np.arange(to[-1])
    out = total[first]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        w = words[at[i] : at[i + 1]]
        out[to[i]] = (w * factor[: len(w)]).sum(dtype=U) + U(len(w))
    return mix(out), to


def windows_of(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` words of each text, and their ranges.

    A window has the hash that ``shingles_of`` gives a whole text of its words
    if these are fewer than a shingle.
    """
    have = np.maximum(np.diff(at) - n + 1, 0)
    to = np.concatenate(([0], np.cumsum(have)))
    factor = mix(np.arange(1, n + 1, dtype=U) * U(_BASE)) | U(1)
    first = np.repeat(at[:-1] - to[:-1], have) + np.arange(to[-1])
    total = np.full(len(first), n, U)
    for j in range(n):
        total += words[first + j] * factor[j]
    return mix(total), to


def shingle_sets(column: pa.Array, k: int, short: tuple[int, ...] = ()) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a string column.

    ``short`` are further lengths, less than ``k``, of which all windows are in the sets.
    """
    data, at = utf8_buffers(column)
    for a, z in slices(at):
        words, ends = words_of(data, at[a : z + 1])
        found = [shingles_of(words, ends, k), *(windows_of(words, ends, n) for n in short)]
        for i in range(z - a):
            s = np.sort(np.concatenate([h[to[i] : to[i + 1]] for h, to in found]))
            yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s
