"""Spark session helpers.

The library never creates a session behind the caller's back: operators take
DataFrames and return DataFrames.  ``get_session`` is a convenience for tests,
the bench and scripts.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_session(master: str | None = None, app: str = "quarry",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master or os.environ.get("QUARRY_MASTER"):  # else the cluster's own setting holds
        builder = builder.master(master or os.environ["QUARRY_MASTER"])
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is.  Only in local mode, where it may be unset, do we pick a scratch
    folder of our own; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    current = spark.conf.get(_CHECKPOINT_KEY, None) or sc._jsc.sc().getCheckpointDir()
    if hasattr(current, "isDefined"):  # scala Option
        current = current.get() if current.isDefined() else None
    if current:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="quarry-ckpt-", dir="/tmp")
    spark.conf.set(_CHECKPOINT_KEY, path)
    sc.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder of its own for every call, in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new shared folder and read back, so that later reads prune its columns."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
