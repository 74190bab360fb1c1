"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the call site of every Column operation costs several JVM round trips each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "rollmill", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators expect; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a folder every executor can reach, and must be set. Only a
    local master without it, as in tests, gets a temporary folder, remembered in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="rollmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def shuffle_width(spark: SparkSession) -> int:
    """How many buckets an ordered or salted pass should aim for."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate table to the shared folder and continue from it.

    For narrow results of costly work that several passes read: the work is done once, lineage is cut, and a
    lost executor costs a re-read only.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share costly per-row work evenly when the input has fewer partitions than there are cores.

    For scans and what follows them without a shuffle: a small file of one row group is read by a single task.
    Large inputs have partitions enough and pass through.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
