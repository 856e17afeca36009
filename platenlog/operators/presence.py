"""When devices were on line, from their announcements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platenlog.functions.codes import RECORD_LIFETIME_SECONDS


def presence_intervals(announcements: DataFrame, ttl: int = RECORD_LIFETIME_SECONDS) -> DataFrame:
    """Spans in which a device always had a live record; ``announcements`` is ``device_id, ts``.

    A record lives ``ttl`` seconds, so an announcement exactly that old has
    expired. Announcements that share a ``ttl``-wide bucket are never apart by
    as much and are combined before the shuffle: a device sends on at most one
    row per bucket however often it announces itself.
    """
    life = ttl * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    bucketed = (
        announcements.select("device_id", at.alias("at"))
        .groupBy("device_id", (F.col("at") - F.pmod("at", F.lit(life))).alias("bucket"))
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    )
    in_order = W.partitionBy("device_id").orderBy("bucket")
    before = F.lag("last").over(in_order)
    breaks = F.when(before.isNull() | (F.col("first") >= before + life), 1).otherwise(0)
    spans = (
        bucketed.withColumn("breaks", breaks)
        .withColumn("span", F.sum("breaks").over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .groupBy("device_id", "span")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("announcements"))
    )
    return spans.select(
        "device_id",
        "span",
        F.timestamp_micros("first").alias("online_from"),
        F.timestamp_micros(F.col("last") + life).alias("offline_at"),
        "announcements",
    )
