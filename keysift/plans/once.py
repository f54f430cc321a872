"""A result that several steps read is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base(spark: SparkSession) -> str:
    """The session's shared folder, ``spark.checkpoint.dir``; only in local mode one is made where none is set."""
    context = spark.sparkContext
    if not context.getCheckpointDir() and (named := spark.conf.get("spark.checkpoint.dir", None)):
        context.setCheckpointDir(named)
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='keysift-')}")
    return context.getCheckpointDir()


def shared(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def once(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them from there: they outlive lost executors."""
    base(df.sparkSession)
    return df.checkpoint()
