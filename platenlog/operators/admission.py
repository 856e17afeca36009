"""Which requests are let in, and what the rest are told.

Columns read: ``method, path, content_type, body_bytes`` by the gate;
``op_code, document_format, doc_bytes, avail_bytes, lookup_job_id`` by
admission. Optional columns with their meaning when absent: ``read_ok`` (true),
``reject_reason`` (none), ``has_group`` (true), ``write_ok`` (true).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platenlog.functions import codes


def _optional(df: DataFrame, name: str, default) -> Column:
    """A column the input may leave out; NULL counts as the default too."""
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def gate(df: DataFrame) -> DataFrame:
    """Add ``http_status``: 404, 400, 500, 413 or 200; the first rule that fails decides."""
    wrong_place = (F.coalesce(F.col("method"), F.lit("")) != "POST") | ~F.coalesce(F.col("path"), F.lit("")).isin(
        "/ipp/print", "/"
    )
    wrong_type = ~F.startswith(F.coalesce(F.col("content_type"), F.lit("")), F.lit("application/ipp"))
    undecodable = F.col("reject_reason").isNotNull() if "reject_reason" in df.columns else F.lit(False)
    return df.withColumn(
        "http_status",
        F.when(wrong_place, 404)
        .when(wrong_type, 400)
        .when(~_optional(df, "read_ok", True), 500)
        .when(F.col("body_bytes") > codes.MAX_BODY_BYTES, 413)
        .when(undecodable, 400)
        .otherwise(200),
    )


def served(op_code: Column | str = "op_code") -> Column:
    """Whether the operation is one of those answered."""
    return (F.col(op_code) if isinstance(op_code, str) else op_code).isin(*codes.SERVED_OPERATIONS)


def dispatch(df: DataFrame) -> DataFrame:
    """Add ``supported`` and the ``dispatch_status`` an operation gets before any check of its own."""
    return df.withColumn("supported", served()).withColumn(
        "dispatch_status", F.when(F.col("supported"), codes.OK).otherwise(codes.OPERATION_NOT_SUPPORTED)
    )


def format_accepted(document_format: Column | str = "document_format") -> Column:
    """Exact, case-sensitive match; a request that names no format passes."""
    column = F.col(document_format) if isinstance(document_format, str) else document_format
    return F.coalesce(column, F.lit(codes.DEFAULT_FORMAT)).isin(*codes.STORED_FORMATS)


def non_empty(doc_bytes: Column | str = "doc_bytes") -> Column:
    column = F.col(doc_bytes) if isinstance(doc_bytes, str) else doc_bytes
    return F.coalesce(column, F.lit(0)) > 0


def space_ok(doc_bytes: Column | str = "doc_bytes", avail_bytes: Column | str = "avail_bytes") -> Column:
    """Room for twice the document and 10 MiB more; unknown free space passes."""
    size = (F.col(doc_bytes) if isinstance(doc_bytes, str) else doc_bytes).cast("bigint")
    avail = (F.col(avail_bytes) if isinstance(avail_bytes, str) else avail_bytes).cast("bigint")
    return avail.isNull() | (avail >= size * 2 + codes.SPACE_HEADROOM)


def takes_job_id(df: DataFrame) -> Column:
    """Print requests that pass every check made before a job id is drawn."""
    return (
        (F.col("op_code") == codes.PRINT_JOB) & _optional(df, "has_group", True) & format_accepted() & non_empty()
    )


def admission(df: DataFrame) -> DataFrame:
    """Add ``status`` and the ``reason`` a client is told (NULL where none is sent).

    The branches stand in the order of the checks: the first that applies wins.
    Asking for a job is judged only on whether it names one; whether the job
    exists is a join, see ``jobs.job_lookup``.
    """
    op = F.col("op_code")
    printing = op == codes.PRINT_JOB
    grouped = _optional(df, "has_group", True)
    names_job = grouped & F.col("lookup_job_id").isNotNull()
    verdicts = [
        (~served(), codes.OPERATION_NOT_SUPPORTED, codes.MESSAGE_NOT_SERVED),
        (printing & ~grouped, codes.BAD_REQUEST, codes.MESSAGE_NO_GROUP),
        (printing & ~format_accepted(), codes.FORMAT_NOT_SUPPORTED, codes.MESSAGE_FORMAT),
        (printing & ~non_empty(), codes.BAD_REQUEST, codes.MESSAGE_EMPTY),
        (printing & ~space_ok(), codes.INTERNAL_ERROR, codes.MESSAGE_SPACE),
        (printing & ~_optional(df, "write_ok", True), codes.INTERNAL_ERROR, codes.MESSAGE_WRITE),
        ((op == codes.GET_JOB_ATTRIBUTES) & ~names_job, codes.BAD_REQUEST, codes.MESSAGE_NO_JOB_ID),
        (op == codes.GET_PRINTER_ATTRIBUTES, codes.OK, None),
    ]
    # A NULL operation code belongs to no branch; it is as unserved as an unknown one.
    unknown = op.isNull()
    status = F.when(unknown, codes.OPERATION_NOT_SUPPORTED)
    reason = F.when(unknown, codes.MESSAGE_NOT_SERVED)
    for applies, code, message in verdicts:
        status = status.when(applies, code)
        reason = reason.when(applies, F.lit(message))
    return df.withColumn("status", status.otherwise(codes.OK)).withColumn("reason", reason.otherwise(codes.MESSAGE_OK))
