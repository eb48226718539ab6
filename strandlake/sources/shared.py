"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and all runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own_dir[0]
