"""The folder for tables that a job writes on its way."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A new path under the folder that the cluster shares; a machine-local one only where none is named, as in tests."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/quillon-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
