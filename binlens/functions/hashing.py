"""Seeded hashes of numpy arrays (splitmix64), for draws that any task repeats alike."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.asarray(x).astype(np.uint64) + _STEP
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """In [0, 1), from hashed keys."""
    return (mixed(x) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
