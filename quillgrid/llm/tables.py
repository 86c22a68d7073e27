"""Tables in the folder that all machines of a cluster share."""

from pyspark.sql import DataFrame

from quillgrid.plans.lineage import fresh_path


def stored(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: nothing before it is computed again.

    ``group`` is for rows of large binary values: the size in bytes of the row groups, which tasks hold at
    once, and a page then has few rows, as writers only look at its size after a hundred.
    """
    path = fresh_path(df.sparkSession, name)
    options = {} if group is None else {"compression": "zstd", "parquet.block.size": group, "parquet.page.row.count.limit": 16}
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
