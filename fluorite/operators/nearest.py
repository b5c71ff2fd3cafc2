"""Exact nearest rows by squared distance: training rows in boxes of near ones, groups of queries against the boxes they can need."""

from __future__ import annotations

import numpy as np

#: Training rows in a box, and queries in a group.
LEAF, GROUP = 128, 64


def leaves(values: np.ndarray, size: int) -> np.ndarray:
    """An order in which every ``size`` rows lie near each other: split at the middle of the column that spreads most."""
    out, todo = [], [np.arange(len(values))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        part = values[rows]
        column = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        half = -(-len(rows) // size) // 2 * size
        turn = np.argpartition(part[:, column], half)
        todo += [rows[turn[half:]], rows[turn[:half]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _boxes(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(values), size)
    return np.minimum.reduceat(values, at), np.maximum.reduceat(values, at)


def _squares(gaps: list[np.ndarray]) -> np.ndarray:
    """The sum of squares, added from left to right as an expression of columns is."""
    total = gaps[0] * gaps[0]
    for g in gaps[1:]:
        total = total + g * g
    return total


class Index:
    """Training rows: keys are numbers in the order of the rows' keys (equal keys are equal), values have no nulls."""

    def __init__(self, values: np.ndarray, keys: np.ndarray, k: int):
        order = np.lexsort((keys, *values.T))
        ranked = values[order]
        new = np.ones(len(order), bool)
        new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1) | (keys[order[1:]] == keys[order[:-1]])
        place = np.arange(len(order))
        # of rows with equal values, those with the k + 1 smallest keys are enough: one of them may be the query itself
        rows = order[place - np.maximum.accumulate(np.where(new, place, 0)) <= k]
        self.k, self.finite = k, bool(np.isfinite(values).all())
        self.rows = rows[leaves(values[rows], LEAF)] if self.finite else rows
        self.values, self.keys = values[self.rows], keys[self.rows]
        if len(self.rows) and self.finite:
            self.low, self.high = _boxes(self.values, LEAF)

    def search(self, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, training row, distance) of the k nearest rows with another key of each query; ties go to smaller keys."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(self.rows) and len(values):
            fine = np.isfinite(values).all(axis=1) & self.finite
            some = np.flatnonzero(fine)
            some = some[leaves(values[some], GROUP)]
            out += [self._group(values[g], keys[g], g) for g in (some[at : at + GROUP] for at in range(0, len(some), GROUP))]
            out += [self._one(values[i], keys[i], i) for i in np.flatnonzero(~fine).tolist()]
        return tuple(np.concatenate(c) for c in zip(*out))

    def _one(self, value: np.ndarray, key: int, i: int) -> tuple:
        other = np.flatnonzero(self.keys != key)
        away = _squares([value[c] - self.values[other, c] for c in range(len(value))])
        turn = np.lexsort((self.keys[other], away))[: self.k]
        return np.full(len(turn), i), self.rows[other[turn]], away[turn]

    def _away(self, values: np.ndarray, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        away = _squares([values[:, c, None] - self.values[None, at, c] for c in range(values.shape[1])])
        away[keys[:, None] == self.keys[None, at]] = np.inf
        return away

    def _group(self, values: np.ndarray, keys: np.ndarray, number: np.ndarray) -> tuple:
        low, high = values.min(axis=0), values.max(axis=0)
        bound = _squares([np.maximum(np.maximum(self.low[:, c] - high[c], low[c] - self.high[:, c]), 0.0) for c in range(len(low))])
        inner = lambda boxes: (lambda x: x[x < len(self.rows)])((boxes[:, None] * LEAF + np.arange(LEAF)).ravel())
        k, order = self.k, np.argsort(bound, kind="stable")
        some = 1 + -(-(k + 1) // LEAF)
        while True:  # rows of the nearest boxes until every query has k; repeated keys may leave some out
            first = self._away(values, keys, inner(order[:some]))
            enough = first.shape[1] >= k and np.isfinite(worst := np.partition(first, k - 1, axis=1)[:, k - 1].max())
            if enough or some >= len(order):
                break
            some *= 2
        at = inner(np.flatnonzero(bound <= worst) if enough else order)
        at = at[np.argsort(self.keys[at], kind="stable")]
        away = self._away(values, keys, at)
        worst = np.partition(away, k - 1, axis=1)[:, k - 1 : k] if away.shape[1] > k else np.inf
        i, j = np.nonzero((away <= worst) & np.isfinite(away))
        d = away[i, j]
        turn = np.lexsort((j, d, i))
        i, j, d = i[turn], j[turn], d[turn]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        return number[i[keep]], self.rows[at[j[keep]]], d[keep]
