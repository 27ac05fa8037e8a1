"""Whole texts as numpy columns: word spans and 64-bit codes straight from Arrow's buffers.

Words are runs of bytes other than space and \\x09-\\x0D. Work is done in slices of about one MB
that end between words, so memory follows the slice and not the longest text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
LONG_WORD = 256
U64 = np.uint64
_BASE, _SHINGLE_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Byte classes: 0 between words, tokens are runs of one other class. WORD knows one class of token.
WORD = (~SPACE).astype(np.uint8)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (splitmix64's finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BYTES_LOWER = _BYTES[LOWER]
_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        _tables["up"] = powers(_BASE, n)
        _tables["down"] = powers(pow(_BASE, -1, 1 << 64), n)
    return _tables["up"], _tables["down"]


def column(values) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 places where its rows start; null is empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    a = values.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def row_blocks(at: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of whole rows of about `size` bytes each (a longer row is a range of its own)."""
    out, lo, n = [], 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


class Words:
    """Spans and codes of all words of some rows: row r has words first[r]:first[r+1]."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, lower: bool = False, codes: bool = True, classes: np.ndarray = WORD):
        starts, ends, all_codes = [], [], []
        lo, n = 0, len(buf)
        rows = np.zeros(n + 1, bool)
        rows[at] = True
        while lo < n:
            hi = min(n, lo + SLICE)
            while hi < n and not rows[hi]:
                stop = np.flatnonzero(SPACE[buf[hi : hi + 4096]] | rows[hi : min(hi + 4096, n)])
                if len(stop):
                    hi += int(stop[0])
                    break
                hi = min(n, hi + 4096)
            piece = buf[lo:hi]
            kind = classes[piece]
            begins, stops = kind > 0, np.zeros(len(piece) + 1, bool)
            stops[1:] = begins
            change = (kind[1:] != kind[:-1]) | rows[lo + 1 : hi]
            begins[1:] &= change
            stops[1:-1] &= change
            s, e = np.flatnonzero(begins), np.flatnonzero(stops)
            starts.append(s + lo)
            ends.append(e + lo)
            if codes:
                all_codes.append(_codes(piece, s, e, lower))
            lo = hi
        self.buf, self.at = buf, at
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.code = np.concatenate(all_codes) if all_codes else np.zeros(0, U64)
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def whole_windows(self, k: int) -> np.ndarray:
        """Indices of words at which k consecutive words of one row start."""
        n = len(self.start)
        if n < k:
            return np.zeros(0, np.int64)
        last = np.repeat(self.first[1:], self.count) - k
        return np.flatnonzero(np.arange(n) <= last)


def _codes(piece: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit code of each word's bytes."""
    if not len(s):
        return np.zeros(0, U64)
    up, down = _power_tables(len(piece) + 1)
    sums = np.empty(len(piece) + 1, U64)
    sums[0] = 0
    np.cumsum((_BYTES_LOWER if lower else _BYTES)[piece] * up[: len(piece)], out=sums[1:])
    size = (e - s).astype(U64)
    out = mix((sums[e] - sums[s]) * down[s] + size)
    for i in np.flatnonzero(size >= U64(LONG_WORD)):
        word = piece[s[i] : e[i]]
        word = LOWER[word] if lower else word
        out[i] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "little")
    return out


def span_codes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Codes of spans in order that don't overlap."""
    out, lo = [], 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + SLICE, "right")))
        base = int(start[lo])
        out.append(_codes(buf[base : int(end[hi - 1])], start[lo:hi] - base, end[lo:hi] - base, False))
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, U64)


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive codes, modulo 2**64."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    if k <= 8:
        weight = powers(_SHINGLE_BASE, k)
        out = codes[k - 1 : k - 1 + n].copy()
        for j in range(k - 1):
            out += codes[j : j + n] * weight[k - 1 - j]
        return mix(out)
    up, down = powers(_SHINGLE_BASE, len(codes)), powers(pow(_SHINGLE_BASE, -1, 1 << 64), n)
    sums = np.empty(len(codes) + 1, U64)
    sums[0] = 0
    np.cumsum(codes * up, out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down)
