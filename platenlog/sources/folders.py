"""Folders of written tables, in whatever store Spark reaches them."""

from __future__ import annotations

from pyspark.sql import SparkSession

FINISHED = "_SUCCESS"


def _folder(spark: SparkSession, path: str):
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()), held


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, in order; nothing where there is none. One listing."""
    system, held = _folder(spark, path)
    return sorted(status.getPath().getName() for status in system.listStatus(held)) if system.exists(held) else []


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder has come to its end."""
    system, held = _folder(spark, f"{path}/{FINISHED}")
    return system.exists(held)


def remove(spark: SparkSession, path: str) -> None:
    """Take a written table away; nothing happens where there is none."""
    system, held = _folder(spark, path)
    system.delete(held, True)
