"""Hashes of all words of many texts at once: runs of characters in one array, hashed by differences of running sums.

A run's hash is the polynomial sum of its characters' values in a ring of 64 bits, mixed with its length. Sums over the whole
array are taken once, and a run's is the difference of two of them, divided by the power at its start (powers of an odd
number can be inverted).
"""

from __future__ import annotations

import numpy as np

_BASE = 0xD6E8FEB86659FD93
_KEPT = 1 << 19
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for arrays of usual length are kept."""
    global _power, _inverse
    if len(_power) >= n:
        return _power, _inverse
    size = 1 << (n - 1).bit_length()
    step = lambda b: np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)])
    both = step(np.uint64(_BASE)), step(np.uint64(pow(_BASE, -1, 1 << 64)))
    if size <= _KEPT:
        _power, _inverse = both
    return both


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true begin, and where they are past."""
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        turn = np.r_[0, turn]
    if len(inside) and inside[-1]:
        turn = np.r_[turn, len(inside)]
    return turn[::2], turn[1::2]


def hashed(values: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs [first, past) of values."""
    power, inverse = _powers(len(values) + 1)
    total = np.cumsum(values * power[: len(values)], dtype=np.uint64)
    total = np.r_[np.uint64(0), total]
    return mixed((total[past] - total[first]) * inverse[first] + (past - first).astype(np.uint64))
