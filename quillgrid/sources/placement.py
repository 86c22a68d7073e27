"""Even redistribution of rows over tasks."""

from pyspark.sql import DataFrame

from quillgrid.functions import checks


def spread(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """Redistribute into exactly ``partitions`` parts: by key, or evenly without one."""
    checks.whole("partitions", partitions, 1)
    return df.repartition(partitions, *keys)


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a frame read from too few splits to occupy the cluster.

    A compressed or one-row-group file is one task however large it is. Inputs with
    at least two splits per core, so any large table, are left where they are.
    """
    want = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else spread(df, want, *keys)
