"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that all executors share; only a local session without one gets its own, a cluster must name it."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphloom-"))
    return df.checkpoint()
