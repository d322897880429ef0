"""Vectorised k-mer hashing and winnowing over many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads entropy into all bits; works in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    base = np.full(size, _BASE, np.uint64)
    base[0] = 1
    inverse = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    return np.cumprod(base), np.cumprod(inverse)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _symbols(codes: np.ndarray) -> np.ndarray:
    if codes.dtype == np.uint8:
        return _byte_values()[codes]
    return mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every window of k consecutive codes (bytes or code points)."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    size = 1 << max(12, (n + 1).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_symbols(codes) * power[:n], out=sums[1:])
    h = sums[k:] - sums[:-k]
    h *= inverse[: n - k + 1]
    return mix(h)


def _slide(a: np.ndarray, w: int, op) -> np.ndarray:
    """op over every window of w values, by doubling."""
    step = 1
    while step * 2 <= w:
        a = op(a[:-step], a[step:])
        step *= 2
    rest = w - step
    return op(a[: len(a) - rest], a[rest:]) if rest else a


def winnow(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the winnowed k-mers of the texts codes[start:end].

    Of any w consecutive k-mers of one text at least one is selected, so two
    texts that share k + w - 1 codes share a selected k-mer.
    """
    h = window_hashes(codes, k)
    if not len(h):
        return np.zeros(0, np.int64), h
    for start, end in zip(starts.tolist(), ends.tolist()):  # k-mers across the border of two texts
        h[max(start, end - k + 1) : end] = _NONE
    if len(h) < w:
        low = np.full(len(h), h.min(), np.uint64)
    else:
        low = np.zeros(len(h) + w - 1, np.uint64)
        low[w - 1 : len(h)] = _slide(h, w, np.minimum)
        low = _slide(low, w, np.maximum)
    at = np.flatnonzero((low == h) & (h != _NONE))
    return at, h[at]


def blocks(offsets: np.ndarray, limit: int):
    """Ranges of rows whose bytes stay under limit; a longer single row makes its own range."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last
