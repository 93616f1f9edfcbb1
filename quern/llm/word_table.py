"""Ids of distinct words, kept compactly for the tokenizers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray, part: int = 1 << 20) -> np.ndarray:
    """``pool[start : start + size]`` of each, one after the other; about ``part`` places are worked out at a time."""
    past = np.cumsum(size)
    out = np.empty(int(past[-1]) if len(past) else 0, dtype=pool.dtype)
    i, done = 0, 0
    while i < len(past):
        j = max(i + 1, int(np.searchsorted(past, done + part, side="right")))
        at = np.repeat(start[i:j] - (past[i:j] - size[i:j] - done), size[i:j])
        at += np.arange(len(at))
        out[done : past[j - 1]] = pool[at]
        i, done = j, int(past[j - 1])
    return out


class WordTable:
    """Known words are one Arrow array, their ids lie in a flat one.

    Beyond ``limit`` words the table starts anew; words longer than ``longest``
    characters are not kept. ``learn`` gives new words' sizes and all their ids.
    The empty word has no ids.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kind: np.dtype, limit: int = 1_500_000, longest: int = 64):
        self.learn, self.kind, self.limit, self.longest = learn, kind, limit, longest
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([""], pa.string())
        self.start, self.size, self.pool = np.zeros(1, dtype=np.int32), np.zeros(1, dtype=np.int32), np.zeros(0, dtype=self.kind)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pool, and start and size in it of each of these distinct words."""
        if len(self.words) + len(words) > self.limit:
            self._forget()
        at = pc.index_in(words, value_set=self.words)
        fresh = words.filter(pc.is_null(at))
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes, ids = self.learn(fresh.to_pylist())
        pool = np.concatenate([self.pool, ids])
        starts = len(self.pool) + np.cumsum(sizes) - sizes
        known = at >= 0
        start, size = np.empty(len(at), dtype=np.int64), np.empty(len(at), dtype=np.int64)
        start[known], size[known] = self.start[at[known]], self.size[at[known]]
        start[~known], size[~known] = starts, sizes
        short = pc.less_equal(pc.utf8_length(fresh), self.longest)
        if len(fresh) and not pc.all(short).as_py():
            ok = short.to_numpy(zero_copy_only=False)
            fresh, ids, sizes = fresh.filter(short), gathered(pool, starts[ok], sizes[ok]), sizes[ok]
            starts = len(self.pool) + np.cumsum(sizes) - sizes
            self.pool = np.concatenate([self.pool, ids])
        else:
            self.pool = pool
        self.words = pa.concat_arrays([self.words, fresh])
        self.start, self.size = np.concatenate([self.start, starts.astype(np.int32)]), np.concatenate([self.size, sizes.astype(np.int32)])
        return pool, start, size
