"""Joining points to one row per cell when a cell may hold a third of all points."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A cell is hot above both bounds, so there are fewer than 10000 hot cells however
# large the data: that is what makes their broadcast safe.
HOT_FLOOR = 1 << 20
HOT_SHARE = 10_000

BROADCAST_ROWS = 200_000  # rows of about 40 bytes sent to every executor, once counted


def hot_bound(total: int) -> int:
    return max(HOT_FLOOR, total // HOT_SHARE)


def hot_cells(cells: DataFrame, total: int, largest: int) -> DataFrame | None:
    """The cells ``(i, j)`` too large to be one join key; None if there are none."""
    bound = hot_bound(total)
    return cells.filter(F.col("n") > bound).select("i", "j") if largest > bound else None


def outside_hot(points: DataFrame, hot: DataFrame | None) -> DataFrame:
    return points if hot is None else points.join(F.broadcast(hot), ["i", "j"], "left_anti")


def lookup(points: DataFrame, table: DataFrame, rows: int, hot: DataFrame | None,
           how: str = "inner") -> DataFrame:
    """Join points to ``table``: at most one row per cell ``(i, j)``, at most ``rows`` in all.

    A small table is broadcast. Of a large one, only the rows of hot cells are, and the
    points of those cells stay where they are while the others are shuffled by cell.
    """
    if rows <= BROADCAST_ROWS:
        return points.join(F.broadcast(table), ["i", "j"], how)
    if hot is None:
        return points.join(table, ["i", "j"], how)
    hot_rows = F.broadcast(table.join(F.broadcast(hot), ["i", "j"], "left_semi"))
    kept = points.join(F.broadcast(hot), ["i", "j"], "left_semi").join(hot_rows, ["i", "j"], how)
    return kept.unionByName(outside_hot(points, hot).join(table, ["i", "j"], how))
