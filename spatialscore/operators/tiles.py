"""The nearest references of the points of one tile, by dense distances between blocks of near points and references."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Points of a block on average, and references first tried for each wanted neighbour.
BLOCK_POINTS, FIRST = 32, 8


def _blocks(px: np.ndarray, py: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of the points, in blocks of near ones."""
    side = max(1, int(np.sqrt(len(px) / BLOCK_POINTS)))
    cell = [np.minimum((side * ((v - v.min()) / (np.ptp(v) or 1.0))).astype(np.int64), side - 1) for v in (px, py)]
    key = cell[0] * side + cell[1]
    order = np.lexsort((py, px, key))
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, cuts):
        yield from (part[i:i + 2 * BLOCK_POINTS] for i in range(0, len(part), 2 * BLOCK_POINTS))


def nearest_in_tile(px: np.ndarray, py: np.ndarray, limit2: np.ndarray, x: np.ndarray, y: np.ndarray, k: int,
                    allowed: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
                    exclude_zero: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distance and position of the ``k`` nearest references of every point, ties by position; infinity if there are fewer.

    Only references whose squared distance is at most ``limit2`` count, and those for which ``allowed(points, refs)``, a
    matrix over positions, holds. A block of points first meets the references around its centre; a point whose k-th of
    these is not surely nearer than all others goes on with more of them.
    """
    dist, at = np.full((len(px), k), np.inf), np.full((len(px), k), -1)
    if not len(x) or not len(px):
        return dist, at
    first = FIRST * k
    for block in _blocks(px, py):
        cx, cy = (px[block].min() + px[block].max()) / 2, (py[block].min() + py[block].max()) / 2
        around = np.sqrt((x - cx) ** 2 + (y - cy) ** 2)
        off = np.sqrt((px[block] - cx) ** 2 + (py[block] - cy) ** 2)
        m, left = first, np.arange(len(block))
        while len(left):
            if m < len(x):
                part = np.argpartition(around, m)
                near, edge = np.sort(part[:m]), around[part[m]]
            else:
                near, edge = np.arange(len(x)), np.inf
            rows = block[left]
            dx, dy = px[rows, None] - x[near], py[rows, None] - y[near]
            d2 = dx * dx + dy * dy
            out = d2 > limit2[rows, None]
            if allowed is not None:
                out |= ~allowed(rows, near)
            if exclude_zero:
                out |= d2 == 0
            d = np.where(out, np.inf, np.sqrt(d2))
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            found = np.take_along_axis(d, best, axis=1)
            w = found.shape[1]
            dist[rows, :w] = found
            at[rows, :w] = np.where(np.isfinite(found), near[best], -1)
            reach = np.minimum(dist[rows, k - 1], np.sqrt(limit2[rows]) * (1 + 1e-12))
            left = left[~((reach + off[left]) * (1 + 1e-9) < edge)] if np.isfinite(edge) else left[:0]
            first = m if not len(left) else first
            m *= 2
    return dist, at
