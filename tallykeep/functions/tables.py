"""Cutting lineage, through the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir, or where that is unset, and only in one process, a folder of our own."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallykeep-"))
    elif not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()
