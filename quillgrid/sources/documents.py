"""Documents: one row each, a ``text`` column, any other column identifies the row."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.sources.placement import spread


def numbered_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The lines of text files as ``(name, text)``, numbered from 0 by file and by place in it.

    A line has its place in its split of a file, plus the lines of all splits before: the same number
    however the files are cut into splits. Each split brings one row, counted without its text.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"))      # lines of a split follow one another
    before = W.orderBy("path", "start").rowsBetween(W.unboundedPreceding, -1)
    splits = (lines.groupBy("path", "start").agg(F.count("*").alias("lines"), F.min("place").alias("first"))
              .select("path", "start", "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("skipped")))
    return lines.join(F.broadcast(splits), ["path", "start"]).select(
        (F.col("skipped") + F.col("place") - F.col("first")).alias(name), "text")


def read_documents(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Text files, one document per line, as ``(doc_id, text)``, numbered from 0 by file and line."""
    docs = numbered_lines(spark, path, "doc_id")
    return docs if partitions is None else spread(docs, partitions)


def documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def document_lines(docs: DataFrame) -> DataFrame:
    """Each line becomes a document of its own: ``(doc_id, line_no, text)``."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))


def tokens(text: Column) -> Column:
    """Words of a text: cut at every single blank or line end, nothing else changed.

    A document read from a text file holds no line end, so cutting there too lets
    the counts that do not name a document skip the explode into lines.
    """
    return F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ", -1)
