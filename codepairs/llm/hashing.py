"""Hashes of words, word shingles and byte windows of many texts at once, by array operations.

A window of bytes is hashed as the difference of two sums of a running
polynomial modulo 2^64, moved to a common power and mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes worked off at once
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all of them; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    """A number drawn for each byte."""
    return mix(np.arange(256, dtype=np.uint64) + np.uint64((seed + 1) << 32))


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``; those of pieces of the usual size are kept."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, PIECE + 4096), base, np.uint64)]))
        if n <= 2 * PIECE:
            _powers[base] = known
    return known[:n]


def running(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the polynomial before each byte and after the last."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * powers(BASE, len(data)), out=sums[1:])
    return sums


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the bytes from ``start`` to ``end``."""
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, nulls as empty, and the places at which its texts begin, with the end."""
    column = column.fill_null(b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


_LETTERS = byte_values(0)


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the numbers of words before each text and at the end.

    Words are runs of bytes other than space and tab to carriage return; with ``lower``, A to Z count as a to z.
    """
    space = SPACE[data]
    first = ~space
    last = first.copy()
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[inner] = True
    first[1:] &= space[:-1] | begins[1:-1]
    last[:-1] &= space[1:] | begins[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        # Whole words of about one piece, or one longer word.
        upto = max(at + 1, int(np.searchsorted(end, start[at] + PIECE, side="right")))
        low, high = start[at], end[upto - 1]
        part = LOWER[data[low:high]] if lower else data[low:high]
        hashes[at:upto] = spans(running(part, _LETTERS), start[at:upto] - low, end[at:upto] - low)
        at = upto
    return hashes, np.searchsorted(start, bounds)


def shingle_sets(hashes: np.ndarray, first: np.ndarray, size: int):
    """For each text the sorted distinct hashes of its runs of ``size`` words; of a shorter text, the whole as one."""

    def chained(parts: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(parts[0]), len(parts), dtype=np.uint64)
        for part in parts:
            out = mix(out * np.uint64(BASE) + part)
        return out

    n = len(hashes)
    runs = chained([hashes[j : n - size + 1 + j] for j in range(size)]) if n >= size else np.zeros(0, np.uint64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        else:
            yield chained([hashes[i : i + 1] for i in range(a, b)]) if b > a else np.zeros(0, np.uint64)
