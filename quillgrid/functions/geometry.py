"""Plane geometry on flat double columns.

Distances stay squared and every expression keeps one operand order. Rounding of
a difference, a square and a sum is monotone, so the bounds below, taken from the
true extent of the points in a cell, agree with the point-by-point test to the
last bit: if ``farthest <= D*D`` then each pair passes, if ``nearest > D*D`` none does.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


MOST_CELLS = 1 << 52  # of a row of cells on either side of 0


def squared_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def _to_each(x: Column, y: Column, centers: Sequence[tuple[float, float]], then) -> Column:
    """Least of ``then(d2, rank)`` over fixed centers."""
    each = [then(squared_distance(x, y, F.lit(float(cx)), F.lit(float(cy))), F.lit(rank))
            for rank, (cx, cy) in enumerate(centers)]
    return each[0] if len(each) == 1 else F.least(*each)


def nearest_squared(x: Column, y: Column, centers: Sequence[tuple[float, float]]) -> Column:
    """Squared distance to the closest of some fixed centers."""
    return _to_each(x, y, centers, lambda d2, rank: d2)


def nearest_center_struct(x: Column, y: Column, centers: Sequence[tuple[float, float]]) -> Column:
    """``(d2, center)`` of the closest center, the lowest rank on ties."""
    return _to_each(x, y, centers, lambda d2, rank: F.struct(d2.alias("d2"), rank.alias("center")))


def cell_side(distance: float) -> float:
    """Side of a cell whose diagonal is half the distance."""
    return distance / (2 * math.sqrt(2))


def cell_index(coordinate: Column, side: float) -> Column:
    """The cell of a coordinate; stops the query where doubles can no longer tell cells apart."""
    cells = coordinate / F.lit(side)
    far = F.raise_error(F.lit("a coordinate is more than 2^52 cells away from 0")).cast("double")
    return F.floor(F.when(F.abs(cells) <= F.lit(float(MOST_CELLS)), cells).otherwise(far))


EXTENT = ("x_lo", "x_hi", "y_lo", "y_hi")


def extent(x: str = "x", y: str = "y") -> list[Column]:
    """Aggregates that give the bounding box of a group of points."""
    return [
        F.min(x).alias("x_lo"), F.max(x).alias("x_hi"),
        F.min(y).alias("y_lo"), F.max(y).alias("y_hi"),
    ]


def _gap(a_lo, a_hi, b_lo, b_hi) -> Column:
    return F.greatest(b_lo - a_hi, a_lo - b_hi, F.lit(0.0))


def _reach(a_lo, a_hi, b_lo, b_hi) -> Column:
    return F.greatest(a_hi - b_lo, b_hi - a_lo)


def nearest_between(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Lower bound on the squared distance between points of two boxes."""
    gx = _gap(a["x_lo"], a["x_hi"], b["x_lo"], b["x_hi"])
    gy = _gap(a["y_lo"], a["y_hi"], b["y_lo"], b["y_hi"])
    return gx * gx + gy * gy


def farthest_between(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Upper bound on the squared distance between points of two boxes."""
    rx = _reach(a["x_lo"], a["x_hi"], b["x_lo"], b["x_hi"])
    ry = _reach(a["y_lo"], a["y_hi"], b["y_lo"], b["y_hi"])
    return rx * rx + ry * ry


def box(prefix: str) -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in EXTENT}


def point_box(x: Column, y: Column) -> dict[str, Column]:
    return {"x_lo": x, "x_hi": x, "y_lo": y, "y_hi": y}
