"""The best few items of each of many queries, by blocks of scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Queries and items of a block of scores: 8 MB.
BLOCK = 1024


def values(ids: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Whole numbers as they are, anything else as objects."""
    if pa.types.is_integer(ids.type) and not ids.null_count:
        return np.asarray(ids)
    out = np.empty(len(ids), dtype=object)
    out[:] = ids.to_pylist()
    return out


def _order(ids: np.ndarray) -> np.ndarray:
    if ids.dtype != object:
        return ids
    place = {v: i for i, v in enumerate(sorted(set(ids), key=lambda v: (v is not None, v)))}
    return np.array([place[v] for v in ids], dtype=np.int64)


class Best:
    """At most ``k`` items of each of ``n`` queries: the highest scores, the smaller id at equal ones."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.row, self.score, self.exact, self.ids = np.empty(0, np.int64), np.empty(0), np.empty(0), None
        self.least = np.full(n, -np.inf)
        self.new: list[tuple] = []

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, names: np.ndarray | None = None, exact: np.ndarray | None = None) -> None:
        """Scores of queries from ``first`` on (rows) and items (columns); a query called as the item is passed over, and so is a score of minus infinity.

        Items are ordered by ``scores``; ``exact`` is what is given in their place.
        """
        top = self.least[first : first + len(scores)]
        if scores.shape[1] > self.k + 1:
            top = np.maximum(top, np.partition(scores, -self.k - 1, axis=1)[:, -self.k - 1])
        r, t = np.nonzero((scores >= top[:, None]) & (scores > -np.inf))
        if names is not None:
            other = np.asarray(names[first + r] != ids[t], dtype=bool)
            r, t = r[other], t[other]
        s = scores[r, t]
        self.new.append((first + r, s, s if exact is None else exact[r, t], ids[t]))

    def settle(self) -> None:
        """Keep the best of what was there and what was added."""
        held = self.new if self.ids is None else [(self.row, self.score, self.exact, self.ids), *self.new]
        self.new = []
        if not held:
            return
        row, score, exact, ids = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((_order(ids), -score, row))
        row = row[order]
        starts = np.searchsorted(row, row, side="left")
        stay = np.arange(len(row)) - starts < self.k
        order = order[stay]
        self.row, self.score, self.exact, self.ids = row[stay], score[order], exact[order], ids[order]
        full = np.arange(len(row))[stay] - starts[stay] == self.k - 1
        self.least[self.row[full]] = self.score[full]
