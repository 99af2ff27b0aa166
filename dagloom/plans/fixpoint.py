"""Loops over DataFrames: lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in the folder the cluster names (a temporary one
    only where none is named and everything runs on this machine), so that plans
    don't grow by round and a lost executor loses nothing."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="dagloom-"))
    return df.checkpoint(eager=True)
