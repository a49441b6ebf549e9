"""Folders for what a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import files


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path that no other run uses in spark.checkpoint.dir, which all executors share; where Spark runs in one process that may be unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{_own(spark, found)}/{tag}-{uuid.uuid4().hex}"


def _own(spark: SparkSession, folder: str) -> str:
    return f"{folder.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> bool:
    """Remove all that this application has written to scratch folders; results that aren't stored elsewhere can't be read afterwards. Whether there was anything."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return bool(found) and files.remove(spark, _own(spark, found))


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` written as Parquet and read again: a loop's plan stays short, and lost executors repeat no earlier round."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
