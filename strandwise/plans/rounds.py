"""Iterations: the state of a round is cut from its lineage by a checkpoint in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as of now, computed once and read from the checkpoint folder from here on.

    The folder is spark.checkpoint.dir; only a session in one process, which has nothing to share it with, gets one of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            place = tempfile.mkdtemp(prefix="strandwise-")
        context.setCheckpointDir(place)
    return df.checkpoint()
