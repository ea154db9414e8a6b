"""Vectorised byte kernels: words, hashes of spans, and sets of word shingles, over the UTF-8 buffer of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: A random number for each byte at each of 64 places; the places of longer spans are mixed in.
_PLACES = 64
_BYTE_AT = np.random.default_rng(0x5EED).integers(0, 1 << 64, _PLACES * 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit (uint64)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null counts as empty."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    bufs = texts.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    if bufs[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    buf = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]]
    return buf, off - off[0]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the number of words before it (one more entry at the end)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~SEPARATOR[buf]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    full = off[:-1] < off[1:]
    first, last = off[:-1][full], off[1:][full] - 1
    start[first] = word[first]
    end[last] = word[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def span_hash(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [s, e), which are not empty, ascend and don't overlap: equal for equal bytes, wherever they stand.

    A hash is a sum of random numbers, one for each (place, byte), so no structure of the bytes makes two of them meet."""
    if not len(s):
        return np.zeros(0, np.uint64)
    size = e - s
    first = np.cumsum(size) - size
    total = int(first[-1] + size[-1])
    place = np.arange(total) - np.repeat(first, size)
    if total == e[-1] - s[0]:
        byte = buf[s[0] : e[-1]]
    else:
        edge = np.zeros(len(buf) + 1, np.int8)
        edge[s] += 1
        edge[e] -= 1
        byte = buf[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    x = _BYTE_AT[(place & (_PLACES - 1)) << 8 | byte]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        x[far] = mix(x[far] + (place[far] // _PLACES).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    h = np.add.reduceat(x, first)
    h += size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(h)


def word_hashes(texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first word of each text, hashes) of the words of a column; fold lower-cases A-Z."""
    buf, off = utf8(texts)
    if fold:
        buf = LOWER[buf]
    s, e, first = words(buf, off)
    return buf, s, e, first, span_hash(buf, s, e)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text as hashes; a shorter text with words is one shingle."""
    out = []
    if len(h) >= k:
        g = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            g *= np.uint64(0x9E3779B97F4A7C15)
            g += h[i : i + len(g)]
            g ^= g >> np.uint64(29)
        g = mix(g)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            x = np.sort(g[a : b - k + 1])
            keep = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif n:
            x = np.full(1, n, np.uint64)
            for i in range(a, b):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
