"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir says; where it is unset (a local session), a new temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='boxtrail-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base
