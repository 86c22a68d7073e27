"""Result tables of streams: a folder with one ``batch_id=k`` partition per micro-batch.

A batch that is run again after a failure overwrites its own partition. A partition counts
once its writer has left the mark of success, and partitions that later ones replace are
deleted, so a table stays as small as its contents however long the stream runs.
"""

from pyspark.sql import DataFrame, SparkSession


def partition(table: str, batch_id: int) -> str:
    return f"{table}/batch_id={batch_id}"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def finished(spark: SparkSession, table: str) -> list[int]:
    """The batches whose partitions were written to the end, ascending."""
    where, fs = _files(spark, table)
    marks = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(where, "batch_id=*/_SUCCESS")) or []
    return sorted(int(m.getPath().getParent().getName().partition("=")[2]) for m in marks)


def drop(spark: SparkSession, table: str, batch_ids: list[int]) -> None:
    for k in batch_ids:
        where, fs = _files(spark, partition(table, k))
        fs.delete(where, True)


def remove(spark: SparkSession, folder: str) -> None:
    where, fs = _files(spark, folder)
    fs.delete(where, True)


def prepare(spark: SparkSession, table: str, schema) -> None:
    """Give a new table its schema, so that it can be read before anything arrived."""
    if not finished(spark, table):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(partition(table, -1))


def read(spark: SparkSession, table: str, schema: str, batch_ids: list[int] | None = None) -> DataFrame:
    """The rows of finished partitions, all of them or those named."""
    ids = finished(spark, table) if batch_ids is None else batch_ids
    return spark.read.schema(schema).parquet(*(partition(table, k) for k in ids))
