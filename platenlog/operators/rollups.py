"""Code names and counts over request and message tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platenlog.functions import codes
from platenlog.functions.numbers import code_hex


def with_code_names(df: DataFrame, code: str, rows: list[tuple[int, str]], name: str) -> DataFrame:
    """Attach the name of a code column from one of the fixed tables; unknown codes survive as hex."""
    known = F.broadcast(codes.code_table(df.sparkSession, rows, "_code", "_name"))
    return (
        df.join(known, F.col(code) == F.col("_code"), "left")
        .withColumn(name, F.coalesce("_name", F.when(F.col(code).isNotNull(), code_hex(code))))
        .drop("_code", "_name")
    )


def status_ok(df: DataFrame, code: str = "status") -> DataFrame:
    """Add ``ok`` and the ``status_name`` a client shows."""
    return with_code_names(df, code, codes.CLIENT_STATUSES, "status_name").withColumn("ok", F.col(code) < 0x0100)


def request_rollup(df: DataFrame) -> DataFrame:
    """Requests and document bytes by operation and status, with names joined after the count."""
    counted = df.groupBy("op_code", "status").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("doc_bytes").cast("bigint").alias("doc_bytes")
    )
    named = with_code_names(counted, "op_code", codes.OPERATIONS, "op_name")
    return with_code_names(named, "status", codes.STATUSES, "status_name")


def reject_rollup(df: DataFrame) -> DataFrame:
    """Undecodable messages by reason and by the bytes that were missing."""
    return (
        df.where(F.col("error").isNotNull())
        .groupBy(
            F.col("error.reason").alias("reason"), F.col("error.need").alias("need"), F.col("error.have").alias("have")
        )
        .agg(F.count(F.lit(1)).alias("messages"))
    )
