"""Spanning links inside one task: shrink the pairs a tile finds to a forest,
so a group of n near copies sends n - 1 rows instead of n squared."""

from __future__ import annotations

import numpy as np


def roots(n: int, a: np.ndarray, b: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the pairs a, b.
    ``start`` carries the result of earlier pairs on."""
    p = np.arange(n) if start is None else start
    while True:
        pa, pb = p[a], p[b]
        open_ = pa != pb
        if not open_.any():
            return p
        a, b = a[open_], b[open_]
        lo, hi = np.minimum(pa[open_], pb[open_]), np.maximum(pa[open_], pb[open_])
        np.minimum.at(p, hi, lo)
        while True:
            q = p[p]
            if np.array_equal(p, q):
                break
            p = q
