"""The E8 lattice: nearest points and their neighbours."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np


def _roots() -> np.ndarray:
    """The 240 shortest vectors: two entries of +-1, or all of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [[x / 2 for x in signs] for signs in product((1, -1), repeat=8) if signs.count(-1) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def _even_integers(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: round, and if the sum is odd, round
    the coordinate with the largest error the other way."""
    near = np.rint(x)
    error = x - near
    worst = np.abs(error).argmax(axis=1)
    row = np.arange(len(x))
    odd = near.sum(axis=1).astype(np.int64) % 2 != 0
    near[row, worst] += np.where(odd, np.where(error[row, worst] >= 0, 1.0, -1.0), 0.0)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row: even integer points, or those shifted by one half."""
    whole = _even_integers(x)
    half = _even_integers(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


def neighbours(x: np.ndarray, points: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` neighbours of ``points`` that are closest to ``x``, as (rows, count, 8)."""
    lead = (x - points) @ ROOTS.T
    best = np.argpartition(-lead, count - 1, axis=1)[:, :count]
    best = np.take_along_axis(best, np.argsort(-np.take_along_axis(lead, best, axis=1), axis=1), axis=1)
    return points[:, None, :] + ROOTS[best]
