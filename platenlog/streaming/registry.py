"""The registry as a stream: ids, jobs, archive, answers, notices and listings per micro-batch.

Everything a batch writes goes to folders of its own batch id, which a replay replaces, and
everything it carries over is read from runs of the batches before it. So a
batch can be run again at any time and leaves the same tables.

Layout under one path: ``draws`` (every job id drawn, with the status its request
got), ``answers`` and ``archive`` grow by a partition per batch. ``counters`` (last id drawn per session),
``index`` (jobs by session and id, for look-ups) and ``newest`` (first listing page per session) are
kept in merged runs (``streaming.runs``): a batch writes what it has changed and opens the buckets it asks for,
however many sessions and jobs there have been. ``run`` holds
the id of the stream the tables belong to: batch ids mean nothing to another one.

``draws`` is what counts. A run that is not there, because a step was added to a
running stream or a checkpoint was put back by more batches than are kept, is made again from
the draws of its batches. A new checkpoint on tables that hold something is refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from platenlog.functions import codes, numbers
from platenlog.operators.admission import admission
from platenlog.operators.jobs import assign_job_ids, job_lookup, job_rows
from platenlog.sources import folders
from platenlog.sources.documents import archive_in_place, notice, with_file_names
from platenlog.streaming.runs import Runs, no_rows

Step = Callable[[DataFrame, int], None]

# So many job ids of a session lie together in the index; a session with many more is in many buckets.
STRETCH = 1 << 16

COUNTERS = "session_id STRING, last_id BIGINT"
INDEX = (
    "session_id STRING, job_id BIGINT, created_seq BIGINT, state INT, name STRING, originating_user STRING, "
    "time_created BIGINT, file_name STRING, size_bytes BIGINT"
)
DRAWS = (
    "session_id STRING, job_id BIGINT, created_seq BIGINT, state INT, name STRING, originating_user STRING, "
    "time_created BIGINT, file_name STRING, size_bytes BIGINT, status INT, batch_id BIGINT"
)
NEWEST = (
    "session_id STRING, page ARRAY<STRUCT<modified: TIMESTAMP, file_name: STRING, size_bytes: BIGINT>>, files BIGINT"
)
ANSWERS = (
    "seq BIGINT, session_id STRING, status INT, reason STRING, job_id INT, job_uri STRING, state INT, "
    "state_reasons STRING, job_name STRING, originating_user STRING, k_octets INT, time_at_creation INT, "
    "batch_id BIGINT"
)
SLIM = [
    "seq", "session_id", "arrived_at", "op_code", "job_name", "user_name", "document_format", "doc_bytes",
    "lookup_job_id", "avail_bytes",
]
OPTIONAL = ["has_group", "write_ok"]
QUERY_ID = "sql.streaming.queryId"


class ForeignTables(RuntimeError):
    """The tables belong to a stream with another checkpoint."""


def lay_down(spark: SparkSession, path: str, schema: str, partition: str = "batch_id") -> None:
    """An empty table where there is none yet, so that the first batch has one to read."""
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)]
    spark.range(0, 0, 1, 1).select(*columns).write.mode("append").partitionBy(partition).parquet(path)


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Replace this batch's partition as a whole, in files of a sensible size."""
    rows.hint("rebalance").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batch(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """One batch's partition; nothing is listed but its own files."""
    own = f"{path}/batch_id={batch_id}"
    if not folders.finished(spark, own):
        return no_rows(spark, schema)
    return spark.read.schema(schema).option("basePath", path).parquet(own)


def claim(batch: DataFrame, path: str) -> None:
    """Make sure that the tables are this stream's, or nobody's yet."""
    spark = batch.sparkSession
    mine = spark.sparkContext.getLocalProperty(QUERY_ID) or ""
    held = [r.run_id for r in spark.read.schema("run_id STRING").parquet(f"{path}/run").limit(2).collect()]
    if not held:
        if not draws_table(spark, path).isEmpty():
            raise ForeignTables(f"{path} holds jobs, but not the stream they come from")
        spark.range(1).select(F.lit(mine).alias("run_id")).write.mode("overwrite").parquet(f"{path}/run")
    elif held != [mine]:
        raise ForeignTables(
            f"{path} was written by stream {held[0]}, and this is {mine}: a new checkpoint needs new tables"
        )


def draws_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DRAWS).parquet(f"{path}/draws")


def jobs_table(spark: SparkSession, path: str) -> DataFrame:
    """The jobs stored so far, with the batch that stored them."""
    return draws_table(spark, path).where(F.col("status") == codes.OK).drop("status")


def _slim(batch: DataFrame) -> DataFrame:
    """Request columns only: documents stay out of every join and window."""
    return batch.select(*SLIM, *[c for c in OPTIONAL if c in batch.columns])


def _batch_jobs(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The jobs one batch has stored."""
    return read_batch(spark, f"{path}/draws", DRAWS, batch_id).where(F.col("status") == codes.OK).drop("status")


def _between(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    return draws_table(spark, path).where(F.col("batch_id").between(first, last))


def _last_ids(drawn: DataFrame) -> DataFrame:
    """Ids drawn count, not jobs stored: a refused print has used one up."""
    return drawn.groupBy("session_id").agg(F.max("job_id").alias("last_id"))


def counters(path: str) -> Runs:
    """The last id drawn in each session."""
    return Runs(
        f"{path}/counters",
        COUNTERS,
        ["session_id"],
        lambda: F.xxhash64("session_id"),
        lambda spark, first, last: _last_ids(_between(spark, path, first, last)),
        buckets=16,
    )


def job_index(path: str) -> Runs:
    """The jobs stored, by session and stretch of ids."""

    def stored(spark: SparkSession, first: int, last: int) -> DataFrame:
        return _between(spark, path, first, last).where(F.col("status") == codes.OK).drop("status", "batch_id")

    stretch = lambda: F.xxhash64("session_id", F.floor(F.col("job_id") / STRETCH))
    return Runs(f"{path}/index", INDEX, ["session_id", "job_id"], stretch, stored, written_once=True)


def registry_step(spark: SparkSession, path: str) -> Step:
    """Number this batch's jobs from where the batches before stopped, and store them."""
    lay_down(spark, f"{path}/draws", DRAWS)
    spark.range(0, 0, 1, 1).select(F.lit("").alias("run_id")).write.mode("append").parquet(f"{path}/run")
    held = counters(path)

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        claim(batch, path)
        requests = _slim(batch)
        own = requests.select("session_id").distinct()
        before = held.matching(own, batch_id)
        numbered = assign_job_ids(admission(requests), drawn=before.select("session_id", "last_id"))
        write_batch(job_rows(numbered), f"{path}/draws", batch_id)
        # From what was written, so ids and counters cannot disagree.
        held.write(_last_ids(read_batch(session, f"{path}/draws", DRAWS, batch_id)), batch_id)

    return step


def archive_step(spark: SparkSession, path: str) -> Step:
    """Write the payloads of this batch's stored prints where they were read; names come from the registry."""

    def step(batch: DataFrame, batch_id: int) -> None:
        archive_in_place(admission(batch), f"{path}/archive", batch_id)

    return step


def archive_table(spark: SparkSession, path: str) -> DataFrame:
    """The archive under its file names; select from it first what is wanted, to move only that."""
    return with_file_names(spark.read.parquet(f"{path}/archive").drop("batch_id"), jobs_table(spark, path))


def lookup_step(spark: SparkSession, path: str, printer_uri: str) -> Step:
    """Answer this batch's look-ups from the registry so far; follows the registry step.

    The index already holds this batch's jobs, and only those with a lower
    ``seq`` than the look-up are visible to it. Only the buckets that some
    look-up of the batch asks for are opened, and only the rows asked for enter the join.
    """
    lay_down(spark, f"{path}/answers", ANSWERS)
    held = job_index(path)

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        held.write(_batch_jobs(session, path, batch_id).drop("batch_id"), batch_id)
        requests = _slim(batch)
        asked = (
            requests.where(F.col("op_code") == codes.GET_JOB_ATTRIBUTES)
            .select("session_id", numbers.as_u32("lookup_job_id").alias("job_id"))
            .where(F.col("job_id").isNotNull())
            .distinct()
        )
        answers = job_lookup(requests, held.matching(asked, batch_id + 1), F.lit(printer_uri))
        write_batch(answers, f"{path}/answers", batch_id)

    return step


def notify_step(path: str, hook: Callable[[DataFrame, int], None]) -> Step:
    """Hand this batch's stored jobs on; follows the registry step."""

    def step(batch: DataFrame, batch_id: int) -> None:
        hook(notice(_batch_jobs(batch.sparkSession, path, batch_id), f"{path}/archive"), batch_id)

    return step


def _listed(files: DataFrame, size: int) -> DataFrame:
    """The newest page of each session, one row each, and how many files it has."""
    newest = W.partitionBy("session_id").orderBy(F.desc("modified"), "file_name")
    best = (
        files.withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= size)
        .groupBy("session_id")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", F.struct("modified", "file_name", "size_bytes").alias("file")))).alias("_best"))
    )
    counted = files.groupBy("session_id").agg(F.sum("files").alias("files"))
    return best.join(counted, "session_id").select("session_id", F.col("_best.file").alias("page"), "files")


def _files(jobs: DataFrame) -> DataFrame:
    modified = F.timestamp_seconds("time_created").alias("modified")
    return jobs.select("session_id", modified, "file_name", "size_bytes", F.lit(1).cast("bigint").alias("files"))


def listings(path: str, size: int = codes.PAGE_SIZE) -> Runs:
    """The newest page of each session as of its last job."""

    def derive(spark: SparkSession, first: int, last: int) -> DataFrame:
        jobs = jobs_table(spark, path)
        touched = jobs.where(F.col("batch_id").between(first, last)).select("session_id").distinct()
        return _listed(_files(jobs.where(F.col("batch_id") <= last).join(touched, "session_id", "left_semi")), size)

    return Runs(f"{path}/newest", NEWEST, ["session_id"], lambda: F.xxhash64("session_id"), derive, buckets=16)


def listing_step(spark: SparkSession, path: str, size: int = codes.PAGE_SIZE) -> Step:
    """Keep the newest page of every session fresh; follows the registry step.

    The page after a batch is the newest of the page before it and the batch's
    own jobs; only sessions with new jobs are read and written.
    """
    held = listings(path, size)

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        added = _files(_batch_jobs(session, path, batch_id))
        own = added.select("session_id").distinct()
        shown = held.matching(own, batch_id)
        # The first file of a page stands for all files there were.
        earlier = shown.select("session_id", F.posexplode("page").alias("_at", "_file"), F.col("files").alias("_files")).select(
            "session_id",
            "_file.modified",
            "_file.file_name",
            "_file.size_bytes",
            F.when(F.col("_at") == 0, F.col("_files")).otherwise(0).alias("files"),
        )
        held.write(_listed(earlier.unionByName(added), size), batch_id)

    return step


def newest_page(spark: SparkSession, path: str, size: int = codes.PAGE_SIZE) -> DataFrame:
    """The listing as of the last finished batch."""
    held = listings(path, size)
    shown = held.read(spark, held.last_batch(spark) + 1)
    return shown.select("session_id", F.posexplode("page").alias("_at", "_file"), "files").select(
        "session_id", F.col("_at").cast("bigint").alias("position"), "_file.file_name", "_file.size_bytes", "_file.modified", "files"
    )


def run_steps(requests: DataFrame, checkpoint: str, *steps: Step) -> StreamingQuery:
    """Run the steps in order on every micro-batch until what is there now is used up."""

    def each(batch: DataFrame, batch_id: int) -> None:
        for step in steps:
            step(batch, batch_id)

    return (
        requests.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_registry(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Ids that continue across micro-batches; every job stored once."""
    return run_steps(requests, checkpoint, registry_step(requests.sparkSession, path))


def stream_archive(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The registry, and the payloads under their file names."""
    spark = requests.sparkSession
    return run_steps(requests, checkpoint, registry_step(spark, path), archive_step(spark, path))


def stream_lookup(requests: DataFrame, path: str, checkpoint: str, printer_uri: str) -> StreamingQuery:
    """The registry, and answers to look-ups from it as it grows."""
    spark = requests.sparkSession
    return run_steps(requests, checkpoint, registry_step(spark, path), lookup_step(spark, path, printer_uri))


def stream_listing(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The registry, and the newest listing page after each batch."""
    spark = requests.sparkSession
    return run_steps(requests, checkpoint, registry_step(spark, path), listing_step(spark, path))
