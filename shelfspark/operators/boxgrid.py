"""Boxes of one crowded image without a matrix of all pairs: a uniform grid tells
which boxes can overlap, and boxes are worked off in rank order, a block at a time.

Only boxes that share a cell are compared, so rules must not join boxes that do
not touch; memory is that of a block's matrix and a bounded number of pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Boxes of a block (its matrix has as many rows and columns), and pairs compared at once.
BLOCK, PAIRS = 1024, 1 << 20


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intersections and areas of boxes (last axis: x1, y1, x2, y2), broadcast."""
    w = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    h = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    size = [np.maximum(x[..., 2] - x[..., 0], 0) * np.maximum(x[..., 3] - x[..., 1], 0) for x in (a, b)]
    return np.maximum(w, 0) * np.maximum(h, 0), size[0], size[1]


def iou(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    both, sa, sb = overlap(a, b)
    union = sa + sb - both
    return both / (union + eps) if eps else np.divide(both, union, out=np.zeros_like(both), where=union > 0)


class Grid:
    """Square cells over some boxes, as many as boxes or fewer where boxes are large."""

    def __init__(self, box: np.ndarray):
        fine = box[np.isfinite(box).all(axis=1)]
        fine = fine if len(fine) else np.zeros((1, 4))
        self.low = np.minimum(fine[:, :2], fine[:, 2:]).min(axis=0)
        self.high = np.maximum(fine[:, :2], fine[:, 2:]).max(axis=0)
        self.n = max(1, int(np.sqrt(len(box))))
        while self.n > 1 and self._count(box).sum() > 8 * len(box):
            self.n //= 2

    def _ranges(self, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last cell of each box in both directions; what is not finite reaches to the edge."""
        step = np.maximum((self.high - self.low) / self.n, 1e-12)
        ends = np.stack([box[:, :2], box[:, 2:]])
        first = np.nan_to_num(ends.min(axis=0), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        last = np.nan_to_num(ends.max(axis=0), nan=np.inf, posinf=np.inf, neginf=-np.inf)
        return tuple(np.clip(np.floor((np.clip(x, self.low, self.high) - self.low) / step), 0, self.n - 1).astype(np.int64) for x in (first, last))

    def _count(self, box: np.ndarray) -> np.ndarray:
        a, b = self._ranges(box)
        return (b - a + 1).prod(axis=1)

    def cells(self, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(box, cell) of every cell that a box reaches."""
        a, b = self._ranges(box)
        wide = b[:, 0] - a[:, 0] + 1
        count = wide * (b[:, 1] - a[:, 1] + 1)
        who = np.repeat(np.arange(len(box)), count)
        k = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        return who, (a[who, 1] + k // wide[who]) * self.n + a[who, 0] + k % wide[who]


def _met(cell: np.ndarray, who: np.ndarray, held_cell: np.ndarray, held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(held, who) that share a cell, some pairs more than once; ``held_cell`` ascending."""
    low, high = np.searchsorted(held_cell, cell, "left"), np.searchsorted(held_cell, cell, "right")
    n = high - low
    at = 0
    total = np.cumsum(n)
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        some = n[at:end]
        j = np.repeat(np.arange(at, end), some)
        i = np.repeat(low[at:end], some) + np.arange(len(j)) - np.repeat(np.cumsum(some) - some, some)
        for c in range(0, len(j), PAIRS):  # a cell alone may hold more
            yield held[i[c : c + PAIRS]], who[j[c : c + PAIRS]]
        at = end


def pick(box: np.ndarray, bad: Callable[[np.ndarray, np.ndarray], np.ndarray], first: int = 0) -> list[int]:
    """Positions of boxes kept in order: one goes if it is ``bad(kept, it)`` with a
    kept one before it; the ``first`` stay in any case."""
    kept: list[int] = []
    many = len(box) > BLOCK
    if many:
        grid = Grid(box)
        who, cell = grid.cells(box)
        held_cell, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a in range(0, len(box), BLOCK):
        b = min(a + BLOCK, len(box))
        free = np.ones(b - a, dtype=bool)
        if many:
            at, end = np.searchsorted(who, [a, b])
            for i, j in _met(cell[at:end], who[at:end], held_cell, held):
                free[j[bad(box[i], box[j])] - a] = False
        free[: max(0, first - a)] = True
        ids = a + np.flatnonzero(free)
        m = bad(box[ids][:, None], box[ids][None, :])
        free = np.ones(len(ids), dtype=bool)
        new = []
        for k in range(len(ids)):
            if free[k] or ids[k] < first:
                new.append(int(ids[k]))
                free &= ~m[k]
        kept += new
        if many and b < len(box):
            mine = np.isin(who[at:end], new)
            held_cell, held = np.concatenate([held_cell, cell[at:end][mine]]), np.concatenate([held, who[at:end][mine]])
            order = np.argsort(held_cell, kind="stable")
            held_cell, held = held_cell[order], held[order]
    return kept


def near(a: np.ndarray, b: np.ndarray, threshold: float, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, IoU) of all pairs from ``threshold`` on, which is above 0."""
    grid = Grid(np.concatenate([a, b]))
    who, cell = grid.cells(b)
    order = np.argsort(cell, kind="stable")
    left, right, score = [], [], []
    mine, mine_cell = grid.cells(a)
    for j, i in _met(mine_cell, mine, cell[order], who[order]):
        s = iou(a[i], b[j], eps)
        hit = s >= threshold
        left.append(i[hit]), right.append(j[hit]), score.append(s[hit])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, s = np.concatenate(left), np.concatenate(right), np.concatenate(score)
    _, once = np.unique(i * len(b) + j, return_index=True)
    return i[once], j[once], s[once]


def matched(a: np.ndarray, b: np.ndarray, threshold: float, eps: float) -> int:
    """How many one-to-one pairs there are by descending IoU down to the threshold; ties by row of a, then of b."""
    if threshold > 0 and len(a) * len(b) > PAIRS:
        i, j, s = near(a, b, threshold, eps)
    else:
        m = iou(a[:, None], b[None, :], eps)
        i, j = np.nonzero(m >= threshold)
        s = m[i, j]
    order = np.lexsort((j, i, -s))
    used_i, used_j, n = np.zeros(len(a), bool), np.zeros(len(b), bool), 0
    for x, y in zip(i[order].tolist(), j[order].tolist()):
        if not used_i[x] and not used_j[y]:
            used_i[x] = used_j[y] = True
            n += 1
    return n
