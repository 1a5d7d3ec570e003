"""Vectorised hashes of words, shingles and their minima."""

from __future__ import annotations

import hashlib

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Inverse of ODD modulo 2 ** 64.
UNODD = np.uint64(pow(int(ODD), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD ** i and its inverse for i up to at least ``n``."""
    if len(_powers[0]) <= n:
        size = 1 << max(12, int(n).bit_length())
        for k, base in enumerate((ODD, UNODD)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


def word_hashes(body: bytes) -> np.ndarray:
    """64-bit hashes of the white-space separated words of ``body``."""
    b = np.frombuffer(body, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    inside = np.concatenate([[False], (b != 32) & ((b < 9) | (b > 13)), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(b) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((b + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(body: bytes, size: int) -> np.ndarray:
    """Distinct hashes of the ``size``-word shingles, ascending.

    Fewer words: the whole sequence is the one shingle. No word: none.
    """
    w = word_hashes(body)
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    out = np.full(n, np.uint64(min(len(w), size)), np.uint64)
    for k in range(min(size, len(w))):
        out = mix(out * ODD + w[k : k + n])
    return np.unique(out)


def seeds(count: int, salt: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """``count`` odd multipliers and addends of 32 bits, fixed by ``salt``."""
    drawn = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * ODD + np.uint64(salt))
    return (drawn[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (drawn[count:] >> np.uint64(32)).astype(np.uint32)


def band_hashes(minima: np.ndarray, rows: int) -> np.ndarray:
    """64-bit hashes of runs of ``rows`` minima: (items, bands) from (items, K).

    The band's number is hashed in, so equal runs of two bands differ.
    """
    items, count = minima.shape
    parts = minima[:, : count // rows * rows].reshape(items, count // rows, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, count // rows + 1, dtype=np.uint64) * ODD, parts.shape[:2]).copy()
    for k in range(rows):
        out = mix(out * ODD + parts[:, :, k])
    return out.view(np.int64)


def digest(data: bytes) -> tuple[int, int]:
    """128 bits of BLAKE2b as two signed longs."""
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
