"""Places for files that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``; a local master without that setting
    (tests) gets a temporary folder, a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-gondola-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
