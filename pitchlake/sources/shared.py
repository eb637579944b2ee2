"""The folder that driver and executors share, and intermediate results in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import PySparkRuntimeError
from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where a session of one local process names none, as in tests, a temporary folder of it; a cluster
    has to name one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise PySparkRuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in it."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def settled(rows: DataFrame) -> DataFrame:
    """rows, checkpointed there."""
    root(rows.sparkSession)
    return rows.checkpoint()


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows, written there and read back."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
