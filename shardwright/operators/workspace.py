"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def is_local(master: str) -> bool:
    """Whether executors are threads of the driver."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and tables between stages: spark.checkpoint.dir as the cluster names it.

    Where it is unset, a local session (all executors are threads of the driver, as in tests) gets a temporary folder;
    on a cluster that is an error, because executors would each write to their own disk.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="shardwright-"))
    return sc.getCheckpointDir()
