"""The best k of every query, kept by a task while it passes over blocks of scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Best:
    """Order: score to nine places, then key; the score itself is not rounded. What is held is k rows of every query, whatever the
    number of scores; a query's bound so far spares sorting the rest."""

    def __init__(self, k: int, queries: int):
        self.k, self.kept = k, {}
        self.least = np.full(queries, -np.inf)

    def add(self, lo: int, scores: np.ndarray, keys: np.ndarray, positive: bool = False, among: np.ndarray | None = None) -> None:
        """Scores (queries from ``lo`` on, or those at the places ``among`` behind it, by keys); ``positive``: a score of 0 is no hit.
        Blocks of queries begin at the same places."""
        among = np.arange(len(scores)) if among is None else among
        k, bound = self.k, self.least[lo + among]
        if len(keys) > k and np.isinf(bound).any():
            bound = np.maximum(bound, np.partition(scores, len(keys) - k, axis=1)[:, len(keys) - k])
        taken = scores >= (bound - 2e-9)[:, None]
        q, at = np.nonzero(taken & (scores > 0) if positive else taken)
        if not len(q):
            return
        keys, x, q = keys[at], scores[q, at], among[q]
        if lo in self.kept:
            old = self.kept[lo]
            q, keys, x = np.concatenate([old[0], q]), np.concatenate([old[1], keys]), np.concatenate([old[2], x])
        places = np.round(x, 9)
        order = np.lexsort((np.unique(keys, return_inverse=True)[1] if keys.dtype == object else keys, -places, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order], "left")
        order, place = order[place < k], place[place < k]
        q, keys, x, places = q[order], keys[order], x[order], places[order]
        self.kept[lo] = q, keys, x, places
        self.least[lo + q[place == k - 1]] = places[place == k - 1]

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query's place, key, score, score to nine places)."""
        for lo, (q, keys, x, places) in self.kept.items():
            yield lo + q, keys, x, places
