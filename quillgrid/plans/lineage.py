"""The shared folder and what is written there."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own, since there
    the driver is the only machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get(SETTING, None)
    if named:
        return named
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):  # local-cluster has executors of its own
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillgrid-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute once, keep the rows in the shared folder, forget how they were made."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
