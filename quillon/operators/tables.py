"""Cutting a plan's lineage where its result is read more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Where it is unset, on one machine, a
    temporary folder takes its place; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the folder that all executors share; Spark's cleaner may drop it with its last plan."""
    spark = df.sparkSession
    root = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()
