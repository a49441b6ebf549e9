"""Folders of any store that Spark reaches: what is there, and its removal."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    fs, where = _at(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, in order; none if there is no folder."""
    fs, where = _at(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a file or a folder with all it holds; whether there was one."""
    fs, where = _at(spark, path)
    return fs.delete(where, True)


def rename(spark: SparkSession, path: str, name: str) -> None:
    """Give a file another name in its folder."""
    fs, where = _at(spark, path)
    if not fs.rename(where, _at(spark, f"{path.rpartition('/')[0]}/{name}")[1]):
        raise OSError(f"{path} can't be renamed to {name}")
