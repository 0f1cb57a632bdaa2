"""Ragged arrays in tasks: many short id lists in one flat numpy array."""

from __future__ import annotations

from itertools import chain

import numpy as np


class Ragged:
    """A growing list of integer lists."""

    def __init__(self, dtype=np.int32):
        self.flat = np.zeros(1024, dtype)
        self.ends = np.zeros(1024, np.int64)  # ends[i]: end of list i - 1
        self.n = 0

    def add(self, lists: list) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.extend(np.fromiter(chain.from_iterable(lists), self.flat.dtype, int(sizes.sum())), sizes)

    def extend(self, flat, sizes) -> None:
        """Add lists of ``sizes`` that lie in ``flat`` one after another."""
        used = int(self.ends[self.n])
        need, rows = used + len(flat), self.n + len(sizes) + 1
        if need > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(need - len(self.flat), len(self.flat)), self.flat.dtype)))
        if rows > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros(max(rows - len(self.ends), len(self.ends)), np.int64)))
        self.flat[used:need] = flat
        self.ends[self.n + 1:rows] = used + np.cumsum(sizes)
        self.n += len(sizes)

    def take(self, which: np.ndarray) -> np.ndarray:
        """The lists ``which``, one after another."""
        return taken(self.ends, self.flat, which)


def taken(ends: np.ndarray, flat: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Lists ``which`` of a ragged array, one after another: list i lies at
    ``flat[ends[i]:ends[i + 1]]``."""
    return flat[places(ends, which)]


def places(ends: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Where the items of lists ``which`` lie, one after another."""
    starts = ends[which]
    sizes = ends[which + 1] - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
