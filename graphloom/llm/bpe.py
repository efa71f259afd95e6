"""Byte-pair merges on many short pieces of text at once, in numpy."""

from __future__ import annotations

import numpy as np


class PairTable:
    """(a, b) -> what the two merge to, and the merge's place in the order of merges."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, float]], ids: int):
        self.ids = ids
        keys = {a * ids + b: v for (a, b), v in merges.items()}
        self.key = np.array(sorted(keys), np.int64)
        self.to = np.array([keys[k][0] for k in self.key.tolist()], np.int32)
        self.cost = np.array([keys[k][1] for k in self.key.tolist()], np.float64)

    def of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) * self.ids + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return self.to[at], np.where((a >= 0) & (b >= 0) & (self.key[at] == key), self.cost[at], np.inf)

    def merged(self, ids: np.ndarray) -> np.ndarray:
        """A row for each piece of text, -1 at its end (the last column too): the cheapest merge of each row, the left one of
        equals, is made in step until no row has one."""
        done = ids.copy()
        left, column = np.arange(len(ids)), np.arange(ids.shape[1])
        to, cost = self.of(ids[:, :-1], ids[:, 1:])
        while len(left):
            j = cost.argmin(1)
            go = np.isfinite(cost[np.arange(len(j)), j])
            done[left[~go]] = ids[~go]
            left, ids, to, cost, j = left[go], ids[go], to[go], cost[go], j[go]
            r = np.arange(len(j))
            ids[r, j] = to[r, j]
            after = column[None, :] > j[:, None]
            ids[:, :-1] = np.where(after[:, :-1], ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            for x in (to, cost):
                x[:, :-1] = np.where(after[:, :-2], x[:, 1:], x[:, :-1])
            cost[:, -1] = np.inf
            to[r, j], cost[r, j] = self.of(ids[r, j], ids[r, j + 1])
            r, j = r[j > 0], j[j > 0]
            to[r, j - 1], cost[r, j - 1] = self.of(ids[r, j - 1], ids[r, j])
        return done


def padded(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat, cut by size to the rows of a matrix; -1 behind each row."""
    out = np.full((len(size), int(size.max()) + 1), -1, np.int32)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out
