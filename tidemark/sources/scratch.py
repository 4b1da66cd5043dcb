"""The folder that driver and executors share, for tables that are needed twice."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where it is unset, a temporary folder serves on one
    machine, as in tests; on a cluster that would not be shared, so it is an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_tidemark_dir", None)
    if not found:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = context._tidemark_dir = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(found)
    return found.rstrip("/")
