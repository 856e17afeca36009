"""Listings of archived documents: order, pages, counts, display columns, recovery from names.

A listing row is ``session_id, file_name, size_bytes, modified``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platenlog.functions import codes, display, numbers
from platenlog.operators.ordering import rank_within

FILE_NAME_PARTS = r"^(\d+)_(\d+)_([\s\S]*)\.pdf$"


def newest_first(files: DataFrame) -> DataFrame:
    """Newest first; the name settles ties."""
    return files.orderBy(F.desc("modified"), "file_name")


def archive_counts(files: DataFrame, size: int = codes.PAGE_SIZE) -> DataFrame:
    """Files and listing pages per session."""
    counted = files.groupBy("session_id").agg(F.count(F.lit(1)).alias("files"))
    return counted.withColumn("pages", numbers.pages("files", size))


def page_numbers(files: DataFrame, size: int = codes.PAGE_SIZE) -> DataFrame:
    """Add ``position`` and ``page`` (from 0) of every file in its session, newest first."""
    ranked = rank_within(files, ["session_id"], [F.desc("modified"), F.asc("file_name")], "_rank")
    position = F.col("_rank") - 1
    return (
        ranked.withColumn("position", position)
        .withColumn("page", F.floor(position / size).cast("bigint"))
        .drop("_rank")
    )


def page(files: DataFrame, k: int, size: int = codes.PAGE_SIZE) -> DataFrame:
    """Page ``k`` of every session; sessions that have no such page show page 0.

    Adds ``position, page, files, pages``. Files are numbered as in ``page_numbers``,
    whatever the page, so a hot session is never in one task; the counts are those of the same numbers.
    """
    placed = page_numbers(files, size)
    known = placed.groupBy("session_id").agg((F.max("position") + 1).alias("files"))
    known = known.withColumn("pages", numbers.pages("files", size))
    shown = F.when(F.col("pages") > k, F.lit(k)).otherwise(0)
    return placed.join(known, "session_id").where(F.col("page") == shown)


def display_columns(files: DataFrame) -> DataFrame:
    """What a listing shows of each file."""
    ext = display.extension("file_name")
    return files.select(
        *[c for c in ("session_id",) if c in files.columns],
        "file_name",
        ext.alias("extension"),
        display.mime_of(ext).alias("mime"),
        display.kind_of(display.icon_extension("file_name")).alias("kind"),
        numbers.human_size("size_bytes").alias("size"),
        display.short_stamp(F.unix_millis("modified")).alias("stamp"),
    )


def catalogue_from_names(files: DataFrame) -> DataFrame:
    """Job rows rebuilt from archived names; files not named by the archive are left out."""
    def part(i: int):
        return F.regexp_extract("file_name", FILE_NAME_PARTS, i)

    return files.where(F.col("file_name").rlike(FILE_NAME_PARTS)).select(
        *[c for c in ("session_id",) if c in files.columns],
        part(1).try_cast("bigint").alias("time_created"),
        part(2).try_cast("bigint").alias("job_id"),
        part(3).alias("safe_name"),
        "file_name",
        "size_bytes",
    )
