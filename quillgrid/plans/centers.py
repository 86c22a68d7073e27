"""The nearest of many fixed centers, by a grid of the centers that is searched in rings.

Farthest-first centers lie apart, so a grid with about one of them to a cell has few in each, and a
point that is no outlier meets a handful of centers, however many there are. A search ends once
the nearest center found is nearer than the border of what was searched; the comparison of
distances is that of ``squared_distance``, and ties go to the lowest rank, so the answer
is that of comparing with every center.
"""

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillgrid.plans.within import ranges

POINTS = 1 << 13        # of a batch that are searched at once
SAFE = 1 - 1e-9         # what rounding may take from the distance to a border


class CenterGrid(NamedTuple):
    x: np.ndarray       # the centers, cell by cell
    y: np.ndarray
    rank: np.ndarray
    starts: np.ndarray  # of the cells, by column and row
    left: float
    low: float
    side: float
    columns: int
    rows: int


def center_grid(centers: list[tuple[float, float]]) -> CenterGrid:
    """About one cell for each center."""
    x, y = (np.array(c, float) for c in zip(*centers))
    width, height = float(np.ptp(x)), float(np.ptp(y))
    side = max(math.sqrt(width * height / len(x)), max(width, height) / len(x)) or 1.0
    columns, rows = int(width / side) + 1, int(height / side) + 1
    i = np.minimum(((x - x.min()) / side).astype(np.int64), columns - 1)
    j = np.minimum(((y - y.min()) / side).astype(np.int64), rows - 1)
    cell = i * rows + j
    order = np.argsort(cell, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=columns * rows))])
    return CenterGrid(x[order], y[order], order, starts, float(x.min()), float(y.min()), side, columns, rows)


def _ring(r: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the cells at Chebyshev distance ``r``."""
    span = np.arange(-r, r + 1)
    di, dj = (c.ravel() for c in np.meshgrid(span, span, indexing="ij"))
    at = np.maximum(np.abs(di), np.abs(dj)) == r
    return di[at], dj[at]


def nearest(grid: CenterGrid, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(rank, d2)`` of the nearest center of each point."""
    best, who = np.full(len(x), np.inf), np.full(len(x), len(grid.x), np.int64)
    # a point outside the grid starts from the cell at its border
    i = np.clip(np.floor((x - grid.left) / grid.side), 0, grid.columns - 1).astype(np.int64)
    j = np.clip(np.floor((y - grid.low) / grid.side), 0, grid.rows - 1).astype(np.int64)
    open_, r = np.arange(len(x)), 0
    while len(open_):
        di, dj = _ring(r)
        ci, cj = i[open_, None] + di, j[open_, None] + dj
        there = (ci >= 0) & (ci < grid.columns) & (cj >= 0) & (cj < grid.rows)
        point, cell = np.nonzero(there)[0], (ci * grid.rows + cj)[there]
        size = grid.starts[cell + 1] - grid.starts[cell]
        at = ranges(grid.starts[cell], size)
        point = open_[np.repeat(point, size)]
        if len(point):
            dx, dy = x[point] - grid.x[at], y[point] - grid.y[at]
            d2 = dx * dx + dy * dy
            first = np.flatnonzero(np.append(True, point[1:] != point[:-1]))     # rows of a point follow one another
            mine, low = point[first], np.minimum.reduceat(d2, first)
            tied = np.where(d2 == np.repeat(low, np.diff(np.append(first, len(d2)))), grid.rank[at], len(grid.x))
            rank = np.minimum.reduceat(tied, first)
            better = (low < best[mine]) | ((low == best[mine]) & (rank < who[mine]))
            best[mine[better]], who[mine[better]] = low[better], rank[better]
        gap = np.full(len(open_), np.inf)        # to the nearest border beyond which the grid goes on
        a, b, px, py = i[open_], j[open_], x[open_], y[open_]
        for goes_on, distance in (
                (a - r > 0, px - (grid.left + (a - r) * grid.side)), (a + r < grid.columns - 1, grid.left + (a + r + 1) * grid.side - px),
                (b - r > 0, py - (grid.low + (b - r) * grid.side)), (b + r < grid.rows - 1, grid.low + (b + r + 1) * grid.side - py)):
            gap = np.where(goes_on, np.minimum(gap, np.maximum(distance, 0)), gap)
        open_ = open_[~(best[open_] < gap * gap * SAFE)]
        r += 1
        if r > max(grid.columns, grid.rows):
            break
    return who, best


def nearest_of_many(points: DataFrame, centers: list[tuple[float, float]]) -> DataFrame:
    """``(id, center, d2)`` of ``(id, x, y)``."""
    grid = center_grid(centers)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, POINTS):
                part = batch.slice(at, POINTS)
                rank, d2 = nearest(grid, part.column("x").to_numpy(), part.column("y").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rank.astype(np.int32)), pa.array(d2)], names=["id", "center", "d2"])
    return points.select("id", "x", "y").mapInArrow(searched, "id long, center int, d2 double")
