"""Where intermediate tables go: the folder that the cluster shares, or one of this machine for a local session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own, since one
    machine runs all its tasks; a cluster has no folder that could be guessed, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="spark-scratch-")
        context.setCheckpointDir(_own[context.applicationId])
    return _own[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{scratch_root(spark)}/tideline/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a scratch table and read again, so that their lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
