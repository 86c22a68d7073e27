"""A uniform grid over the plane and what its cell sizes say about outliers.

The cell diagonal is half the distance D. So the 3x3 block around a cell lies
within D of each point of the cell, and the 7x7 block covers all that does; up to
rounding, as the cell of a point near a border is decided by a rounded quotient.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.functions import checks
from quillgrid.functions.geometry import EXTENT, box, cell_index, cell_side, extent, farthest_between

NEAR, FAR = 1, 3   # half widths of the 3x3 and the 7x7 block
TILE_BITS = 6      # tiles of 64x64 cells


def locate(points: DataFrame, distance: float) -> DataFrame:
    """Add the cell ``(i, j)`` of every point."""
    side = cell_side(checks.positive("distance", distance))
    return points.withColumns({"i": cell_index(F.col("x"), side), "j": cell_index(F.col("y"), side)})


def point_cells(points: DataFrame, distance: float) -> DataFrame:
    return locate(points, distance).select("id", "i", "j")


def cell_histogram(points: DataFrame, distance: float, extents: bool = False) -> DataFrame:
    """Points per occupied cell, and their extent if asked for; partial sums leave each partition, not points."""
    return locate(points, distance).groupBy("i", "j").agg(F.count("*").alias("n"), *(extent() if extents else []))


def _tile(index: Column) -> Column:
    return F.shiftright(index, TILE_BITS)


def _tiles(index: str) -> Column:
    """The one or two tiles whose rim reaches this index."""
    return F.explode(F.sequence(_tile(F.col(index) - FAR), _tile(F.col(index) + FAR)))


def neighbourhoods(cells: DataFrame) -> DataFrame:
    """Points in the 3x3 (``n3``) and 7x7 (``n7``) block of each occupied cell.

    Cells meet in tiles of 64x64 with a rim of three, so about 1.2 rows per cell are
    shuffled instead of 49, and a tile holds at most 70x70 rows whatever the number
    of points. Inside its tile a cell is laid on the seven rows it counts for, and a
    sliding range along the row adds up the columns. Of cells with extents, those of
    the cell and of its 3x3 block (``near_``) are kept too.
    """
    placed = (cells.withColumn("ti", _tiles("i")).withColumn("tj", _tiles("j"))
              .repartition("ti", "tj"))
    laid = (placed.withColumn("di", F.explode(F.sequence(F.lit(-FAR), F.lit(FAR))))
            .withColumn("row", F.col("i") + F.col("di"))
            .filter(_tile(F.col("row")) == F.col("ti")))
    along = W.partitionBy("ti", "tj", "row").orderBy("j")
    is_near = F.abs("di") <= NEAR
    near = along.rangeBetween(-NEAR, NEAR)
    extents = [c for c in EXTENT if c in cells.columns]
    reach = {f"near_{c}": (F.min if c.endswith("lo") else F.max)(F.when(is_near, F.col(c))).over(near) for c in extents}
    return (
        laid.withColumns({"n3": F.sum(F.when(is_near, F.col("n")).otherwise(F.lit(0))).over(near),
                          "n7": F.sum("n").over(along.rangeBetween(-FAR, FAR)), **reach})
        .filter((F.col("di") == 0) & (_tile(F.col("j")) == F.col("tj")))
        .select("i", "j", "n", "n3", "n7", *extents, *reach)
    )


def may_have_outliers(blocks: DataFrame, distance: float, neighbours: int) -> DataFrame:
    """The cells that can have a point with at most ``neighbours`` points in reach.

    In all others the 3x3 block has more points, and the true extents show, in the very
    arithmetic of the point test, that each of them is in reach of each point of the cell.
    """
    whole = farthest_between(box(""), box("near_")) <= F.lit(distance * distance)
    return blocks.filter((F.col("n3") <= F.lit(neighbours)) | ~whole)


def cell_neighbourhoods(points: DataFrame, distance: float) -> DataFrame:
    return neighbourhoods(cell_histogram(points, distance))


def approximate_outliers(points: DataFrame, distance: float, neighbours: int) -> DataFrame:
    """Points that surely have at most ``neighbours`` points in reach, and doubtful ones.

    The number of exact outliers lies between ``sure`` and ``sure + uncertain``, unless
    points lie at a distance from each other that differs from ``distance`` by rounding only.
    """
    return bounds(cell_neighbourhoods(points, distance), neighbours)


def bounds(blocks: DataFrame, neighbours: int) -> DataFrame:
    limit = F.lit(checks.whole("neighbours", neighbours))
    total = lambda kind: F.coalesce(F.sum(F.when(kind, F.col("n"))), F.lit(0).cast("long"))
    return blocks.agg(
        total(F.col("n7") <= limit).alias("sure"),
        total((F.col("n3") <= limit) & (F.col("n7") > limit)).alias("uncertain"),
    )


def smallest_cells(points: DataFrame, distance: float, cells: int) -> DataFrame:
    """The occupied cells with fewest points, ties by cell."""
    checks.whole("cells", cells)
    return cell_histogram(points, distance).orderBy("n", "i", "j").limit(cells)


def count_points(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("points"))
