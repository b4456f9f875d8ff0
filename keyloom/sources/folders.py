"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent and Spark runs in one process (tests), a local folder is set; on a
    cluster its absence is an error, as executors don't see each other's local folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="keyloom-"))
            found = context.getCheckpointDir()
    return found
