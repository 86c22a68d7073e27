"""From raw documents to packed training sequences.

Each stage works on all that the one before kept, read back from a table in the shared
folder. Columns of the documents pass through every stage but the last, whatever they are.
"""

from pyspark.sql import DataFrame, SparkSession

from quillgrid.llm import decontaminate, odd_sketch, packing, quality, surrogates
from quillgrid.llm.tables import stored


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.selected(docs, quality.model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return odd_sketch.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not made of test items."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    return surrogates.without_private_data(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences."""
    return packing.pack(docs)


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontaminate", decontaminated), ("pii", private), ("pack", packed)]
#: No SQL states a trained classifier or a tokeniser; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
