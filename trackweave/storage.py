"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


class NoSharedFolder(ValueError):
    """The session names no folder that all executors share; no work can be done without, so nothing takes it for a failed step."""


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset a local session, whose tasks run in the driver's own process,
    gets a temporary folder; on a cluster that is an error, as no executor would see another's files."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="trackweave-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")
