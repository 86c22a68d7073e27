"""Points in the plane as flat columns ``(id, x, y)``."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import checks
from quillgrid.sources.documents import numbered_lines
from quillgrid.sources.placement import spread

MODES = ("fail", "drop")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def points(df: DataFrame, x: str | Column, y: str | Column, id: str | Column | None = None,
           mode: str = "fail") -> DataFrame:
    """Shape any frame into points.

    A missing or non-finite coordinate has no cell: ``mode='fail'`` stops the query
    at such a row, ``mode='drop'`` leaves it out. Without ``id`` the result serves
    the cell-level operators only.
    """
    checks.one_of("mode", mode, MODES)
    col = lambda c: F.col(c) if isinstance(c, str) else c
    wanted = [] if id is None else [col(id).cast("long").alias("id")]
    out = df.select(*wanted, col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))
    good = _finite(F.col("x")) & _finite(F.col("y"))
    if mode == "drop":
        return out.filter(good)
    stop = F.raise_error(F.lit("point with a missing or non-finite coordinate")).cast("double")
    return out.withColumn("x", F.when(good, F.col("x")).otherwise(stop))


def parse_points(df: DataFrame, text: str = "text", id: str = "id", mode: str = "fail") -> DataFrame:
    """Read ``x,y`` from a text column; fields after the second are ignored."""
    fields = F.split(F.col(text), ",", -1)
    coordinate = lambda k: F.get(fields, k).try_cast("double")
    return points(df, coordinate(0), coordinate(1), id, mode)


def read_points(spark: SparkSession, path: str, mode: str = "fail",
                partitions: int | None = None) -> DataFrame:
    """Headerless ``x,y`` text files. Ids count the lines from 0 by file and place, so the lowest is the first line."""
    out = parse_points(numbered_lines(spark, path, "id"), mode=mode)
    return out if partitions is None else spread(out, partitions)
