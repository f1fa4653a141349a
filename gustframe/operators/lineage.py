"""Cutting a long plan: a table written into the folder that the driver and all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own (tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gustframe.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gustframe-")
        spark.conf.set("gustframe.shared.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a table of files, which later plans read without running what made it, and which outlives any executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
