"""Job ids, the job registry, and look-ups in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platenlog.functions import codes
from platenlog.functions.naming import file_name, job_uri
from platenlog.functions.numbers import as_u32, k_octets, wrap_i32
from platenlog.operators.admission import admission, takes_job_id
from platenlog.operators.ordering import BLOCK_BITS, running_sum

JOB_COLUMNS = [
    "session_id", "job_id", "created_seq", "state", "name", "originating_user", "time_created", "file_name", "size_bytes",
]


def assign_job_ids(requests: DataFrame, block_bits: int = BLOCK_BITS, drawn: DataFrame | None = None) -> DataFrame:
    """The requests that draw a job id, with ``job_id`` counted from 1 per session in ``seq`` order.

    ``drawn`` (``session_id, last_id``) are ids drawn before; counting goes on from there.

    Candidates are numbered before the space check, so a print refused for
    space, or one whose write failed, leaves a gap.
    """
    judged = requests if "status" in requests.columns else admission(requests)
    candidates = judged.where(takes_job_id(judged))
    return running_sum(candidates, ["session_id"], "seq", F.lit(1), "job_id", block_bits, drawn)


def job_rows(numbered: DataFrame) -> DataFrame:
    """What the registry holds of each numbered request, and the ``status`` it got."""
    epoch = F.unix_seconds(F.col("arrived_at").cast("timestamp"))
    name = F.coalesce("job_name", F.lit("Untitled"))
    return numbered.select(
        "session_id",
        "job_id",
        F.col("seq").alias("created_seq"),
        F.lit(codes.COMPLETED).alias("state"),
        name.alias("name"),
        F.coalesce("user_name", F.lit("unknown")).alias("originating_user"),
        epoch.alias("time_created"),
        file_name(epoch, "job_id", name).alias("file_name"),
        F.col("doc_bytes").cast("bigint").alias("size_bytes"),
        "status",
    )


def register_jobs(numbered: DataFrame) -> DataFrame:
    """Registry rows of the numbered requests that were stored."""
    return job_rows(numbered.where(F.col("status") == codes.OK)).select(*JOB_COLUMNS)


def job_lookup(requests: DataFrame, jobs: DataFrame, printer_uri: Column | str) -> DataFrame:
    """Answer every request for a job from the registry.

    A job is visible only in its session and only to requests that came after
    it. Keys are (session, job): a hot session spreads over its jobs, and a
    single much-asked job sits on the streamed side of a left join, which
    adaptive execution splits.
    """
    asked = admission(requests).where(F.col("op_code") == codes.GET_JOB_ATTRIBUTES).select(
        "seq",
        "session_id",
        F.when(F.col("status") == codes.OK, as_u32("lookup_job_id")).alias("asked_id"),
        (F.col(printer_uri) if isinstance(printer_uri, str) else printer_uri).alias("printer_uri"),
    )
    known = jobs.select(*JOB_COLUMNS).withColumnRenamed("session_id", "job_session")
    found = F.col("job_id").isNotNull()
    told = (
        F.when(F.col("asked_id").isNull(), codes.MESSAGE_NO_JOB_ID)
        .when(found, codes.MESSAGE_OK)
        .otherwise(codes.MESSAGE_NO_JOB)
    )
    code = (
        F.when(F.col("asked_id").isNull(), codes.BAD_REQUEST).when(found, codes.OK).otherwise(codes.NOT_FOUND)
    )
    return asked.join(
        known,
        (F.col("session_id") == F.col("job_session"))
        & (F.col("asked_id") == F.col("job_id"))
        & (F.col("created_seq") < F.col("seq")),
        "left",
    ).select(
        "seq",
        "session_id",
        code.alias("status"),
        told.alias("reason"),
        wrap_i32("job_id").alias("job_id"),
        job_uri("printer_uri", "job_id").alias("job_uri"),
        "state",
        F.when(found, "job-completed-successfully").alias("state_reasons"),
        F.col("name").alias("job_name"),
        "originating_user",
        wrap_i32(k_octets("size_bytes")).alias("k_octets"),
        wrap_i32("time_created").alias("time_at_creation"),
    )


def print_answers(requests: DataFrame, printer_uri: Column | str, block_bits: int = BLOCK_BITS) -> DataFrame:
    """What every print request is told: its status, and the job it made where it made one."""
    judged = admission(requests).where(F.col("op_code") == codes.PRINT_JOB)
    uri = F.col(printer_uri) if isinstance(printer_uri, str) else printer_uri
    # All prints in one pass: one that draws no id adds nothing to the count.
    draws = F.when(takes_job_id(judged), 1).otherwise(0)
    numbered = running_sum(judged, ["session_id"], "seq", draws, "job_id", block_bits)
    stored = F.col("status") == codes.OK
    return numbered.select(
        "seq",
        "session_id",
        "status",
        "reason",
        F.when(stored, wrap_i32("job_id")).alias("job_id"),
        F.when(stored, job_uri(uri, "job_id")).alias("job_uri"),
        F.when(stored, codes.COMPLETED).alias("state"),
        F.when(stored, "job-completed-successfully").alias("state_reasons"),
    )
