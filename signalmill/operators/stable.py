"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, from `spark.checkpoint.dir`.

    Only a local session, such as a test, may fall back to a folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="signalmill-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """The same rows, written once, so that lost executors cannot change or redo them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
