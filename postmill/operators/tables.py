"""Tables that steps of an operator share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder (spark.checkpoint.dir), which driver and executors share.

    Only a session in one process without one, as in tests, gets a temporary folder; on a cluster it is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="postmill-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
