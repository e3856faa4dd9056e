"""A folder that driver and executors share, for what queries write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``. Where it is unset a temporary one is made, for local masters only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanlake-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/spanlake/{name}-{uuid.uuid4().hex}"
