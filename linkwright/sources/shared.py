"""Frames that are kept between steps, in the folder that a cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local master gets a folder of its own; a cluster raises."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="linkwright-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written there: later steps read it, and a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
