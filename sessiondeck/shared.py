"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, as the session has it. Where it is unset a local master gets a folder that goes when Python ends; on a cluster that is an error, as a machine's own folder can't be read by the others."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sessiondeck-")
        atexit.register(shutil.rmtree, found, True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")
