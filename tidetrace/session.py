"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without that setting gets a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return base.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df`` in the shared folder, for a table that is read several times after costly steps."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(_shared_folder(df.sparkSession))
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder of the cluster."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
