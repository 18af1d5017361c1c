"""Where intermediate tables go: the folder that the cluster shares between driver and executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; a temporary folder only where one machine is all there is, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cairnframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/cairnframe-scratch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
