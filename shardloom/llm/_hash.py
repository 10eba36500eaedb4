"""64-bit hashing of NumPy arrays, shared by the operators on texts and rows."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Fixed odd base of polynomial hashes.
BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit words."""
    h = h ^ (h >> _U(31))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(32)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, ..., base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """min(v[i:i+w]) for each i, in three passes whatever w (van Herk's way)."""
    n = len(v)
    pad = -n % w
    x = np.concatenate([v, np.full(pad, np.iinfo(_U).max, _U)]).reshape(-1, w)
    head = np.minimum.accumulate(x, axis=1).ravel()
    tail = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])
