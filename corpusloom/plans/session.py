"""Session settings that the library's queries expect."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; only a local master without it gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    sc.setCheckpointDir(found)
