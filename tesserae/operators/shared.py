"""Rows that several branches of a plan read, computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's, or one in the warehouse where none is set. On a cluster it has to be one that
    all executors see."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tesserae-checkpoints"
        if folder.startswith(("file:", "/")) and not context.master.startswith("local") and spark.conf.get("spark.checkpoint.dir", None) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """The rows, computed now and kept as a reliable checkpoint: later branches read them, an executor that is lost costs
    nothing, and how they are dealt and sorted stays known to the plan."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
