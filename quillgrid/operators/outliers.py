"""Distance-based outliers: points with at most M points, themselves included, within D."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import checks
from quillgrid.operators.grid import bounds, cell_histogram, locate, may_have_outliers, neighbourhoods
from quillgrid.plans.hot import hot_cells, lookup
from quillgrid.plans.lineage import cut
from quillgrid.plans.within import count_within


def neighbour_counts(points: DataFrame, distance: float) -> DataFrame:
    """``(id, x, y, n)`` for every point; exactly ``distance`` away still counts."""
    return count_within(points, points, distance)


def _blocks(points: DataFrame, distance: float) -> DataFrame:
    return cut(neighbourhoods(cell_histogram(points, distance, extents=True)))


def _outliers_among(points: DataFrame, blocks: DataFrame, distance: float, neighbours: int) -> DataFrame:
    checks.whole("neighbours", neighbours)
    sparse = cut(may_have_outliers(blocks, distance, neighbours).select("i", "j"))
    total, largest = (v or 0 for v in blocks.agg(F.sum("n"), F.max("n")).first())
    hot = hot_cells(blocks, total, largest)
    candidates = cut(lookup(locate(points, distance), sparse, sparse.count(), hot).select("id", "x", "y"))
    return count_within(candidates, points, distance).filter(F.col("n") <= neighbours)


def exact_outliers(points: DataFrame, distance: float, neighbours: int) -> DataFrame:
    """``(id, x, y, n)`` for the outliers alone.

    Only cells whose 3x3 block holds at most ``neighbours`` points can have outliers, so
    each block brings at most that many candidates, and dense cells none, but for cells
    on which rounding casts doubt: the neighbours of the candidates are counted, not
    those of every point.
    """
    return _outliers_among(points, _blocks(points, distance), distance, neighbours)


def count_exact_outliers(points: DataFrame, distance: float, neighbours: int) -> DataFrame:
    return exact_outliers(points, distance, neighbours).agg(F.count("*").alias("exact"))


def top_outliers(points: DataFrame, distance: float, neighbours: int, rows: int) -> DataFrame:
    """The loneliest outliers: fewest neighbours first, ties by position and id."""
    checks.whole("rows", rows)
    return exact_outliers(points, distance, neighbours).orderBy("n", "x", "y", "id").limit(rows)


def outlier_report(points: DataFrame, distance: float, neighbours: int) -> DataFrame:
    """Exact number and grid bounds in one row."""
    blocks = _blocks(points, distance)
    exact = _outliers_among(points, blocks, distance, neighbours).agg(F.count("*").alias("exact"))
    none = F.lit(0).cast("long")
    both = exact.withColumns({"sure": none, "uncertain": none}).unionByName(
        bounds(blocks, neighbours).withColumn("exact", none))
    return both.agg(*(F.sum(c).alias(c) for c in ("exact", "sure", "uncertain")))
