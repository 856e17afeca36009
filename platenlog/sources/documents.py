"""Archived documents: writing, listing, handing on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from platenlog.functions import codes

ARCHIVE_COLUMNS = ["session_id", "file_name", "size_bytes", "modified", "payload"]


def archive_documents(documents: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Write payloads under their file names, one partition per day.

    For rows that already have a name, as in a micro-batch; names of a bulk load
    come from numbering its requests, see ``archive_in_place``. With a batch id
    only that batch's partitions are replaced, and a replay adds nothing; without one, the days are.
    """
    dated = documents.select(*ARCHIVE_COLUMNS, F.to_date("modified").alias("day"))
    if batch_id is None:
        _replace_days(dated, path)
        return
    (
        dated.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day", "batch_id")
        .parquet(path)
    )


def _replace_days(rows: DataFrame, path: str) -> None:
    """A bulk load owns the days it writes: run again, it leaves the same archive."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def archive_in_place(judged: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Write the payloads of all prints let in, where they were read: no payload is shuffled.

    Whether a print is stored does not depend on its job id, so payloads are
    kept under session and ``seq`` and get their names from the registry when
    they are looked for, see ``with_file_names``. With a batch id that batch's partition is
    replaced, without one the days are.
    """
    stored = judged.where((F.col("op_code") == codes.PRINT_JOB) & (F.col("status") == codes.OK))
    rows = stored.select(
        "session_id",
        F.col("seq").alias("created_seq"),
        F.col("doc_bytes").cast("bigint").alias("size_bytes"),
        F.date_trunc("second", F.col("arrived_at").cast("timestamp")).alias("modified"),
        "payload",
    )
    dated = rows.withColumn("day", F.to_date("modified"))
    if batch_id is None:
        _replace_days(dated, path)
    else:
        dated.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch_id={batch_id}")


def with_file_names(archive: DataFrame, jobs: DataFrame) -> DataFrame:
    """Archived rows under their registry names; select and filter first, to move only what is wanted."""
    names = jobs.select("session_id", "created_seq", "job_id", "file_name")
    return archive.join(names, ["session_id", "created_seq"])


def list_archive(spark: SparkSession, path: str) -> DataFrame:
    """Listing rows of an archive; the payload column is never read."""
    return spark.read.parquet(path).select("session_id", "file_name", "size_bytes", "modified")


def list_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Files of a directory; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .load(directory)
        .select(
            F.element_at(F.split("path", "/"), -1).alias("file_name"),
            "path",
            F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("modified"),
        )
    )


def notice(jobs: DataFrame, directory: str) -> DataFrame:
    """What a consumer is told of a stored job."""
    return jobs.select(
        "job_id",
        F.concat(F.lit(directory.rstrip("/") + "/"), "file_name").alias("file_path"),
        "file_name",
        "size_bytes",
        *[c for c in ("session_id",) if c in jobs.columns],
    )


def notify_jobs(
    jobs: DataFrame, directory: str, hook: Callable[[DataFrame, int], None], checkpoint: str | None = None
) -> StreamingQuery | None:
    """Hand stored jobs to ``hook(notices, batch_id)``: per micro-batch of a stream, once for a table."""
    if not jobs.isStreaming:
        hook(notice(jobs, directory), 0)
        return None
    writer = jobs.writeStream.foreachBatch(lambda batch, batch_id: hook(notice(batch, directory), batch_id))
    if checkpoint is not None:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
