"""Listings laid down by day, with counts that tell which days a page is on.

``files`` is partitioned by day; ``index`` holds how many files a session has of each
day. A page of a session is found in the counts alone, and only the days it falls on are
read and numbered, however long the listing is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platenlog.functions import codes, numbers
from platenlog.operators.ordering import rank_within

FIELDS = "file_name string, size_bytes bigint, modified timestamp, day date"


def write_listing(files: DataFrame, path: str) -> None:
    """Lay ``session_id, file_name, size_bytes, modified`` down under a new path; other columns are left out.

    Rows are dealt by day, session, time and name in ranges, so neither a day nor a session
    has to fit one task. The counts are taken from the files written, and written last: a
    listing without them is not whole.
    """
    place = ["day", "session_id", F.desc("modified"), F.asc("file_name")]
    dated = files.select(
        "session_id",
        "file_name",
        F.col("size_bytes").cast("bigint").alias("size_bytes"),
        F.col("modified").cast("timestamp").alias("modified"),
        F.to_date("modified").alias("day"),
    )
    dated.repartitionByRange(*place).sortWithinPartitions(*place).write.partitionBy("day").parquet(f"{path}/files")
    held = _files(files.sparkSession, path, files.schema["session_id"].dataType.simpleString())
    counted = held.groupBy("session_id", "day").agg(F.count(F.lit(1)).alias("files"))
    counted.write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str, session_type: str) -> DataFrame:
    return spark.read.schema(f"session_id {session_type}, {FIELDS}").parquet(f"{path}/files")


def _on(needed: DataFrame) -> Column:
    """The days asked for as a filter of literals."""
    days = [r.day for r in needed.select("day").distinct().collect()]
    dated = F.col("day").isin([day for day in days if day is not None])
    return dated | F.col("day").isNull() if None in days else dated


def page_days(index: DataFrame, k: int, size: int = codes.PAGE_SIZE) -> DataFrame:
    """``session_id, day, first, files, pages, page``: the days that page ``k`` of each session falls on.

    ``first`` is the position of the day's newest file, ``files`` and ``pages`` are the session's. Sessions that
    have no such page show page 0, as in ``catalogue.page``. A session has one row a day, so its
    days meet in one window; files without a time are their oldest day.
    """
    ahead = W.partitionBy("session_id").orderBy(F.desc_nulls_last("day"))
    whole = W.partitionBy("session_id")
    counted = index.select(
        "session_id",
        "day",
        (F.sum("files").over(ahead) - F.col("files")).alias("first"),
        F.col("files").alias("_of_day"),
        F.sum("files").over(whole).alias("files"),
    ).withColumn("pages", numbers.pages("files", size))
    shown = F.when(F.col("pages") > k, F.lit(k)).otherwise(0).cast("bigint")
    begins = F.col("page") * size
    return (
        counted.withColumn("page", shown)
        .where((F.col("first") < begins + size) & (F.col("first") + F.col("_of_day") > begins))
        .drop("_of_day")
    )


def read_page(
    spark: SparkSession, path: str, k: int, size: int = codes.PAGE_SIZE, sessions: list | None = None
) -> DataFrame:
    """Page ``k`` of every session, or of those named, with ``position, page, files, pages``; rows as ``catalogue.page`` gives them.

    The days that some page is on go to the driver, one date each, and become the partitions that are
    scanned; rows of other sessions' days go in the join. A day's files are numbered by range, so
    a hot day is spread over tasks.
    """
    index = spark.read.parquet(f"{path}/index")
    held = _files(spark, path, index.schema["session_id"].dataType.simpleString())
    if sessions is not None:
        mine = F.col("session_id").isin(*sessions)
        index, held = index.where(mine), held.where(mine)
    needed = page_days(index, k, size)
    held = held.where(_on(needed))
    same = needed.select(F.col("session_id").alias("_session"), F.col("day").alias("_day"), "first", "files", "pages", "page")
    met = held.join(same, (F.col("session_id") == F.col("_session")) & F.col("day").eqNullSafe(F.col("_day")))
    # A day is known by its first position, which is never null.
    ranked = rank_within(met, ["session_id", "first"], [F.desc("modified"), F.asc("file_name")], "_rank")
    position = F.col("first") + F.col("_rank") - 1
    return (
        ranked.withColumn("position", position)
        .where(F.floor(F.col("position") / size) == F.col("page"))
        .select("session_id", "file_name", "size_bytes", "modified", "position", "page", "files", "pages")
    )
