"""The request log derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def operation_of(doc_id):
    """Operation mix: six prints in ten, then one each of the other kinds and one unserved."""
    turn = F.pmod(F.floor(doc_id / 20), F.lit(10))
    return F.when(turn < 6, 2).when(turn == 6, 4).when(turn == 7, 9).when(turn == 8, 11).otherwise(18)


def key_range(spark: SparkSession, sf_dir: str) -> int:
    """One more than the largest customer key: requests are dealt to all customers."""
    return table(spark, sf_dir, "customer").agg((F.coalesce(F.max("c_custkey"), F.lit(0)) + 1).alias("n")).first()["n"]


def request_log(spark: SparkSession, sf_dir: str, payload: bool = False) -> DataFrame:
    """One request per document, in the columns every request operator reads.

    With ``payload`` the document bytes come along; every other job leaves them
    out, so that they are never scanned whole or shuffled.
    """
    d = table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("arrived_at"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    keys = key_range(spark, sf_dir)
    k = F.col("doc_id")
    # Of any length and with characters that a file name does not keep, from whole columns.
    name = F.concat(
        "source", F.lit(" / "), "lang", F.lit(" №"), k.cast("string"), F.lit(" é中"), F.repeat(F.lit(" seite"), (k % 19).cast("int"))
    )
    size = F.when(k % 17 == 0, 0).otherwise(F.octet_length("text")).cast("bigint")
    room = F.when(k % 19 == 0, None).when(k % 23 == 0, 10485760).otherwise(1073741824).cast("bigint")
    slim = d.select(
        k.alias("seq"),
        F.col("source").alias("session_id"),
        operation_of(k).alias("op_code"),
        F.when(k % 13 == 0, "Untitled").otherwise(name).alias("job_name"),
        F.when(k % 5 != 0, k % keys).alias("user_key"),
        F.when(k % 7 == 0, "image/urf")
        .when(k % 7 == 1, "application/PDF")
        .when(k % 7 == 2, "application/octet-stream")
        .otherwise("application/pdf")
        .alias("document_format"),
        size.alias("doc_bytes"),
        F.when(k % 11 != 0, 1 + k % 25).alias("lookup_job_id"),
        room.alias("avail_bytes"),
        *([F.encode("text", "utf-8").alias("payload")] if payload else []),
    )
    return (
        slim.join(e, F.col("seq") == F.col("event_id"))
        .join(customers, F.col("user_key") == F.col("c_custkey"), "left")
        .select(
            "seq",
            "session_id",
            F.col("arrived_at").cast("timestamp").alias("arrived_at"),
            "op_code",
            "job_name",
            F.coalesce("c_name", F.lit("unknown")).alias("user_name"),
            "document_format",
            "doc_bytes",
            "lookup_job_id",
            "avail_bytes",
            *(["payload"] if payload else []),
        )
    )
