"""Polynomial prefix hashes over byte buffers, and word and shingle hashes built on them, all as numpy array operations.

The hash of bytes s..e is (P[e] - P[s]) * B^-s, where P sums a random value of each byte times B^position. It doesn't depend on where the bytes stand.
`Prefix` counts modulo 2^64 (B is odd, so B^-1 exists): fast, but strings of a regular make-up (Thue and Morse's) share such a hash whatever
the base, so it serves only to choose or order places whose bytes are compared afterwards. `Fingerprint` counts modulo the prime 2^31 - 1 with two random
bases, 62 bits: two given strings of n bytes agree with a chance of (n / 2^31)^2 at most, whatever their make-up.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_powers = {}


def _series(factor: int, n: int) -> np.ndarray:
    """factor^0 .. factor^(n - 1) modulo 2^64, kept and doubled as needed."""
    known = _powers.get(factor)
    if known is None:
        known = np.ones(1, _U)
    while len(known) < n:
        known = np.concatenate([known, known * _U(pow(factor, len(known), 1 << 64))])
    _powers[factor] = known
    return known[:n]


def forget() -> None:
    """Drops the powers kept; they are made again as needed."""
    _powers.clear()
    _prime_powers.clear()


def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=_U)


class Prefix:
    """Prefix hashes of a buffer."""

    def __init__(self, buffer: np.ndarray, seed: int = 1, base: int = BASE):
        self.sums = np.zeros(len(buffer) + 1, _U)
        np.cumsum(byte_values(seed)[buffer] * _series(base, len(buffer)), out=self.sums[1:])
        self.back = _series(pow(base, -1, 1 << 64), len(buffer) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


PRIME = _U((1 << 31) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2^63."""
    x = (x & PRIME) + (x >> _U(31))
    x = (x & PRIME) + (x >> _U(31))
    return np.where(x >= PRIME, x - PRIME, x)


_prime_powers: dict[int, np.ndarray] = {}


def _prime_series(factor: int, n: int) -> np.ndarray:
    """factor^0 .. factor^(n - 1) modulo PRIME, kept and doubled as needed."""
    known = _prime_powers.get(factor)
    if known is None:
        known = np.ones(1, _U)
    while len(known) < n:
        known = np.concatenate([known, _reduced(known * _U(pow(factor, len(known), int(PRIME))))])
    _prime_powers[factor] = known
    return known[:n]


class Fingerprint:
    """Prefix hashes of a buffer modulo a prime, for two bases."""

    def __init__(self, buffer: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.lanes = []
        for base in rng.integers(1 << 20, int(PRIME) - 1, 2).tolist():
            values = rng.integers(1, int(PRIME), 256).astype(_U)
            sums = np.zeros(len(buffer) + 1, _U)
            steps = values[buffer]
            steps *= _prime_series(base, len(buffer))
            np.cumsum((steps & PRIME) + (steps >> _U(31)), out=sums[1:])  # each below 2^32, so sums stay below 2^63 for 2^31 bytes
            self.lanes.append((sums, _prime_series(pow(base, -1, int(PRIME)), len(buffer) + 1)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        high, low = (_reduced(_reduced(sums[end] - sums[start]) * back[start]) for sums, back in self.lanes)
        return high << _U(31) | low


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(29))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def space_table() -> np.ndarray:
    """True for space and bytes 9 to 13."""
    table = np.zeros(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


def word_spans(buffer: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the words (runs of other bytes than separators) of all texts. Words end where texts end."""
    n = len(buffer)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separators[buffer]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(buffer: np.ndarray, offsets: np.ndarray, separators: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and len(offsets) offsets into them."""
    starts, ends = word_spans(buffer, offsets, separators)
    return mix(Fingerprint(buffer, seed).of(starts, ends)), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of all texts and offsets into them. A text of fewer words, but at least one, has one shingle: all its words."""
    counts = np.diff(offsets)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(offsets[:-1] - out_offsets[:-1], n) + np.arange(out_offsets[-1])
    left = np.minimum(np.repeat(counts, n), k)
    total = left.astype(_U)
    padded = np.concatenate([words, np.zeros(k, _U)])
    for j in range(k):
        total = total * _U(BASE) + np.where(left > j, padded[first + j], _U(0))
    return mix(total), out_offsets
