"""From captured bodies to the registry in one stream: decode once, set aside, number, answer.

Each micro-batch is decoded once and written once, under its own batch id: requests as slim rows, with
the document where a print is stored, messages that cannot be decoded with their whole body and what
was wrong, and those the gate turned away with their status. The steps of the registry then run on the written
requests of the batch, so no body is read or decoded a second time, and a batch that
stopped half way is run again from its bodies and leaves the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from platenlog.functions import codes
from platenlog.sources import folders
from platenlog.streaming.admission import judged_messages
from platenlog.streaming.registry import SLIM, Step, claim, jobs_table, registry_step
from platenlog.streaming.runs import no_rows

REQUEST, REJECT, REFUSED = "request", "reject", "refused"

TAKEN = (
    "seq BIGINT, session_id STRING, arrived_at TIMESTAMP, op_code INT, job_name STRING, user_name STRING, "
    "document_format STRING, doc_bytes BIGINT, lookup_job_id BIGINT, avail_bytes BIGINT, has_group BOOLEAN, "
    "wanted ARRAY<STRING>, http_status INT, status INT, reason STRING, "
    "error STRUCT<reason: STRING, need: BIGINT, have: BIGINT>, held BINARY"
)
COLUMNS = [*SLIM, "has_group", "wanted", "http_status", "status", "reason", "error"]


def taken_in(messages: DataFrame) -> DataFrame:
    """Judged messages as they are kept: ``kind``, the request columns, and ``held``.

    ``held`` is the document of a stored print and the whole body of a reject; it is cut where it was read.
    """
    judged = judged_messages(messages)
    let_through = (F.col("http_status") == 200) | F.col("error").isNotNull()
    kind = F.when(~let_through, REFUSED).when(F.col("error").isNotNull(), REJECT).otherwise(REQUEST)
    stored = (F.col("op_code") == codes.PRINT_JOB) & (F.col("status") == codes.OK)
    document = F.substr(F.col("body"), (F.col("header_len") + 1).cast("int"))
    held = F.when(kind == REJECT, F.col("body")).when((kind == REQUEST) & stored, document)
    return judged.select(*COLUMNS, held.alias("held"), kind.alias("kind"))


def intake_rows(spark: SparkSession, path: str, kind: str, batch_id: int | None = None) -> DataFrame:
    """What was taken in of one kind, by one batch or by all; bodies are read only if ``held`` is."""
    top = f"{path}/intake"
    batches = folders.names(spark, top) if batch_id is None else [f"batch_id={batch_id}"]
    paths = [f"{top}/{b}/kind={kind}" for b in batches if f"kind={kind}" in folders.names(spark, f"{top}/{b}")]
    if not paths:
        return no_rows(spark, f"{TAKEN}, batch_id BIGINT")
    return spark.read.schema(f"{TAKEN}, batch_id BIGINT").option("basePath", top).parquet(*paths)


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """The quarantine: what could not be decoded, why, and its whole body."""
    return intake_rows(spark, path, REJECT).select(
        "seq", "session_id", "arrived_at", "error", F.col("held").alias("body"), "batch_id"
    )


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of stored prints under their file names; select from it first what is wanted, to move only that."""
    held = intake_rows(spark, path, REQUEST).where(F.col("held").isNotNull())
    names = jobs_table(spark, path).select("session_id", F.col("created_seq").alias("seq"), "job_id", "file_name")
    return held.select("session_id", "seq", "arrived_at", F.col("held").alias("payload")).join(names, ["session_id", "seq"])


def intake_step(path: str, *steps: Step) -> Step:
    """Take a batch of messages in, then run ``steps`` on its requests."""

    def step(batch: DataFrame, batch_id: int) -> None:
        claim(batch, path)
        kept = taken_in(batch)
        # As a whole: what a first try left there goes, also where this one has nothing of a kind.
        kept.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/intake/batch_id={batch_id}")
        requests = intake_rows(batch.sparkSession, path, REQUEST, batch_id)
        for each in steps:
            each(requests, batch_id)

    return step


def stream_capture(messages: DataFrame, path: str, checkpoint: str, *more: Step) -> StreamingQuery:
    """Bodies to registry and quarantine, until what is there now is used up; ``more`` steps follow the registry's.

    ``messages`` has ``seq, session_id, arrived_at, avail_bytes, body`` and, if they were kept, the
    HTTP columns. Run again with the same checkpoint after a failure, it goes on with the batch that failed.
    """
    step = intake_step(path, registry_step(messages.sparkSession, path), *more)
    return (
        messages.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
