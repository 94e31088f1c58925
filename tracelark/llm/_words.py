"""Words of many texts at once: numpy passes over the UTF-8 bytes of an Arrow column.

A word's 64-bit value is a polynomial of its bytes modulo 2**64, so a prefix sum gives all of them in
a few passes; the value is then mixed. Texts are taken in slices of about SLICE bytes, so memory
does not follow the batch (one text is never cut), and what a batch has freed is given back to the system, as a worker outlives its task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_M = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, SLICE + (SLICE >> 1))
        step = np.full(size, _P, np.uint64)
        step[0] = 1
        _pow = np.cumprod(step)
        step[1:] = pow(_P, -1, 1 << 64)
        _inv = np.cumprod(step)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ascii_lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def not_space() -> np.ndarray:
    """Bytes of words `[^\\x20\\x09-\\x0D]+`."""
    t = np.ones(256, bool)
    t[[32, 9, 10, 11, 12, 13]] = False
    return t


def alnum() -> np.ndarray:
    """Bytes of words of a-z, 0-9 and all beyond ASCII, once A-Z are lowered."""
    t = np.zeros(256, bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = True
    return t


LOWER, SPACED, ALNUM = ascii_lower(), not_space(), alnum()


def texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


class Words:
    """Of texts first..first+n-1: at[i]..at[i+1] are text i's words; hash, and start and end in data."""

    def __init__(self, data, off, first, kind):
        lo, hi = int(off[0]), int(off[-1])
        raw = data[lo:hi]
        rel = (off - lo).astype(np.int64)
        low = LOWER[raw]
        w = kind[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[rel] = True
        before = np.zeros(len(raw), bool)
        before[1:] = w[:-1]
        start = np.flatnonzero(w & (~before | edge[:-1]))
        after = np.zeros(len(raw), bool)
        after[:-1] = w[1:]
        end = np.flatnonzero(w & (~after | edge[1:])) + 1
        p, q = _powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * p[:len(raw)], out=sums[1:])
        self.hash = mix((sums[end] - sums[start]) * q[start] + (end - start).astype(np.uint64))
        self.start, self.end, self.raw, self.low, self.rel, self.first = start, end, raw, low, rel, first
        self.at = np.searchsorted(start, rel)
        self.n = len(off) - 1

    def text(self, i: int) -> bytes:
        return self.raw[self.rel[i]:self.rel[i + 1]].tobytes()


def slices(col: pa.Array, kind: np.ndarray) -> Iterator[Words]:
    """The words of a column, some texts at a time."""
    off, data = texts(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE, "right")) - 1)
        yield Words(data, off[i:j + 1], i, kind)
        i = j
    give_back()


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def rolled(w: Words, size: int, whole: bool = False) -> np.ndarray:
    """64-bit values of the runs of `size` words in text order: those within a text, or (whole) those across texts too."""
    m = len(w.hash)
    if m < size:
        return np.zeros(0, np.uint64)
    h = w.hash[:m - size + 1].copy()
    for k in range(1, size):
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h += w.hash[k:m - size + 1 + k]
        h ^= h >> np.uint64(29)
    h = mix(h)
    if whole:
        return h
    text = np.repeat(np.arange(w.n), np.diff(w.at))
    return h[text[:m - size + 1] == text[size - 1:]]


def shingles(w: Words, size: int) -> list[np.ndarray]:
    """Each text's distinct shingles of `size` words as sorted 64-bit values; with fewer words, the whole sequence as one."""
    h = rolled(w, size, True)
    out = []
    for i in range(w.n):
        a, b = int(w.at[i]), int(w.at[i + 1])
        if b - a >= size:
            out.append(np.unique(h[a:b - size + 1]))
        elif b > a:
            v = np.uint64(b - a)
            for x in w.hash[a:b]:
                v = np.uint64((int(v) * 0xC4CEB9FE1A85EC53 + int(x)) & _M)
            out.append(mix(np.array([v], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
