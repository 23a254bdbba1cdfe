"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and all runs on one machine, as in tests."""
    given = spark.conf.get("spark.checkpoint.dir", "")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "millrace-checkpoints")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written and read again, so that the rows are the same however often they are read, whatever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
