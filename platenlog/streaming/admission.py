"""Captured messages to judged requests; stateless, so the same for a table and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platenlog.operators.admission import admission, gate
from platenlog.operators.decode import PREFIXES, decode_messages, request_columns


def judged_messages(messages: DataFrame, prefixes: tuple[int, ...] = PREFIXES) -> DataFrame:
    """Decode, gate and admit every message.

    A message that is let through but cannot be decoded has an ``http_status``
    of 400, no protocol status, and what was wrong with it as its reason. Tables
    without the HTTP columns are taken as let through.
    """
    if {"method", "path", "content_type"} <= set(messages.columns):
        gated = gate(messages.withColumn("body_bytes", F.octet_length("body").cast("bigint")))
    else:
        gated = messages.withColumn("http_status", F.lit(200))
    let_through = F.col("http_status") == 200
    # What the gate turns away, oversized bodies above all, is not decoded.
    decoded = decode_messages(gated.withColumn("_body", F.when(let_through, F.col("body"))), "_body", prefixes)
    judged = admission(request_columns(decoded.drop("_body")))
    sound = F.col("error").isNull()
    return judged.withColumns(
        {
            "http_status": F.when(let_through & ~sound, 400).otherwise(F.col("http_status")),
            "status": F.when(let_through & sound, F.col("status")),
            "reason": F.when(let_through, F.coalesce("error.reason", "reason")),
            "error": F.when(let_through, F.col("error")),
        }
    )


def stream_admission(messages: DataFrame) -> DataFrame:
    """Judged requests of a message stream, in append mode; document bytes are left behind."""
    return judged_messages(messages).drop("body", "tokens", "groups")
