"""Tables in the shared folder that cut a plan's lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir; without one, only a session on a local master has a
    folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/turnmill-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: plans above it start there, and a lost executor costs no
    recomputation of what is below."""
    path = folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
