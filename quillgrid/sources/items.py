"""Item streams as ``(arrival, item)``: ``arrival`` counts arrivals from 0.

A table that numbers its rows from 0 keeps that column as it is, so that "the first n
arrivals" reaches the scan as a plain comparison and later row groups are skipped.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.plans.lineage import cut

ROW_BITS = 33  # of monotonically_increasing_id


def items(df: DataFrame, item: str | Column, arrival: str | Column) -> DataFrame:
    """Batch or streaming frame with the arrival number in a column."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(col(arrival).cast("long").alias("arrival"), col(item).cast("long").alias("item"))


def parse_items(text: str = "value") -> Column:
    """The whole number in a text column; a line that is none stops the query."""
    number = F.trim(F.col(text)).try_cast("long")
    return F.coalesce(number, F.raise_error(F.lit("a line of the item stream is no whole number")).cast("long"))


def number_arrivals(df: DataFrame, item: str | Column, order: list[str], start: int = 0) -> DataFrame:
    """Number the rows ``start``, ``start + 1``, ... along ``order`` where no such column exists.

    ``order`` must be a total order. Rows are range-partitioned and sorted by it, and
    each takes its place in its part plus the rows of the parts before, so no task sees
    more than its range. The ranges are sampled at run time; the cut keeps both steps on
    the same ranges and the rows in place even if executors are lost in between.
    """
    # as many ranges as the input has splits, so that a range is about as large as one
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    value = F.col(item) if isinstance(item, str) else item
    placed = cut(df.select(value.cast("long").alias("item"), *order)
                 .repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("item"))
    # the upper bits number the part, the lower ones the row inside it
    placed = placed.withColumn("mark", F.monotonically_increasing_id()).select(
        "item", F.shiftright("mark", ROW_BITS).alias("part"),
        F.col("mark").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("nth"))
    # one row per part: the window and the broadcast hold at most `tasks` rows
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (placed.groupBy("part").agg(F.count("*").alias("rows"))
               .select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("skipped")))
    return placed.join(F.broadcast(offsets), "part").select(
        (F.col("skipped") + F.col("nth") + start).alias("arrival"), "item")
