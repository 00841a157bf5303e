"""Union-find over whole arrays, for the links that one task finds."""

from __future__ import annotations

import numpy as np


class Forest:
    """Disjoint sets over ``ids`` (sorted and unique); the smallest id of a set is its root."""

    def __init__(self, ids: np.ndarray):
        self.ids = np.unique(ids)
        self.parent = np.arange(len(self.ids))

    def _roots(self, nodes: np.ndarray) -> np.ndarray:
        up = self.parent[nodes]
        while True:
            next_ = self.parent[up]
            if np.array_equal(next_, up):
                return up
            up = next_

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        """Unite the sets of the two ids of every pair."""
        a, b = np.searchsorted(self.ids, left), np.searchsorted(self.ids, right)
        while len(a):
            a, b = self._roots(a), self._roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
        self.parent = self._roots(np.arange(len(self.ids)))

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(self.ids, left), np.searchsorted(self.ids, right)
        return self.parent[a] == self.parent[b]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Every id that isn't a root, and its root."""
        moved = np.flatnonzero(self.parent != np.arange(len(self.ids)))
        return self.ids[moved], self.ids[self.parent[moved]]
