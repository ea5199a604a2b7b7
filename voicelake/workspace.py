"""Fresh folders in the place that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh(spark: SparkSession, job: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, below a temporary folder in local mode and an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voicelake-"))
        found = spark.sparkContext.getCheckpointDir()
    return f"{found.rstrip('/')}/{job}-{uuid.uuid4().hex}"
