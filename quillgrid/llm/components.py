"""Connected components by alternating stars, every step a join or a sum over the edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.tables import forget, stored


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _pairs(edges: DataFrame, u, v) -> DataFrame:
    return edges.select(u.alias("u"), v.alias("v")).filter("u <> v").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """``node, root`` for edges ``(u, v)`` between nodes of any ordered type: the smallest node reachable.

    A node of any degree costs rows in proportion to its edges: its smallest neighbour is
    found by partial sums, and joins on a node that many share can be split. Roots do not
    name themselves.
    """
    edges = stored(_pairs(edges, F.greatest("u", "v"), F.least("u", "v")), "edges")
    before = None
    while (now := _stamp(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        # every larger neighbour goes to the smallest one
        large = _pairs(both.filter("v > u").join(low, "u"), F.col("v"), F.col("low"))
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        # every node and its smaller neighbours go to the smallest of them
        small = large.join(low, "u")
        small = small.select("u", "low").unionByName(small.select(F.col("v").alias("u"), "low"))
        old, edges = edges, stored(_pairs(small, F.col("u"), F.col("low")), "edges")
        forget(old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
