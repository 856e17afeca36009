"""Attribute requests answered from long tables, as the devices are or as they were at the time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Requests and snapshots of one device and so many seconds are put in order together.
STRETCH_SECONDS = 3600


def attribute_answers(requests: DataFrame, attributes: DataFrame, keys: tuple[str, ...] = ("device_id",)) -> DataFrame:
    """What each request is told: one row per value of its device that it asked for.

    ``requests`` has ``seq``, ``keys`` and ``wanted``; ``attributes`` is a long table with ``keys, pos, name,
    value_pos, tag, value``. No list, an empty one and one with ``all`` ask for everything; a name
    that is listed twice is told once. Requests that name attributes meet them by device and name, so
    nothing else of a device is moved for them; only those for everything meet by device alone. Both are
    inner joins, of which adaptive execution splits a much-asked device on either side. A request of
    an unknown or null device has no rows.
    """
    wanted = F.col("wanted")
    asked = requests.select("seq", *keys, "wanted")
    everything = wanted.isNull() | (F.size(wanted) == 0) | F.array_contains(wanted, "all")
    named = asked.where(~everything).select("seq", *keys, F.explode(F.array_distinct("wanted")).alias("name"))
    whole = asked.where(everything).drop("wanted")
    columns = ["seq", *keys, "pos", "name", "value_pos", "tag", "value"]
    by_name = named.join(attributes, [*keys, "name"]).select(columns)
    return by_name.unionByName(whole.join(attributes, list(keys)).select(columns))


def as_of(
    requests: DataFrame, snapshots: DataFrame, key: str = "device_id", at: str = "arrived_at", taken: str = "taken_at",
    stretch: int = STRETCH_SECONDS,
) -> DataFrame:
    """``requests`` with ``taken``: when the last snapshot of their device was taken, at or before ``at``.

    ``snapshots`` has ``key`` and ``taken``; NULL where there was none yet. Times are compared inside
    stretches of ``stretch`` seconds, so a device with very many requests or snapshots is many units of work; what
    came before a stretch is one row for each stretch with a snapshot. Ties between snapshots do not matter;
    requests of a null device or time have none.
    """
    spread = lambda time: F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / stretch)
    own = requests.withColumn("_stretch", spread(at)).withColumn("_time", F.col(at).cast("timestamp"))
    dated = snapshots.select(F.col(key), F.col(taken).cast("timestamp").alias("_time")).where(
        F.col(key).isNotNull() & F.col("_time").isNotNull()
    )
    dated = dated.distinct().withColumn("_stretch", spread("_time"))
    last = dated.groupBy(key, "_stretch").agg(F.max("_time").alias("_last"))
    # Stretches without a snapshot are looked up among those with one.
    held = own.select(key, "_stretch").where(F.col(key).isNotNull()).distinct()
    earlier = W.partitionBy(key).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    opening = (
        held.join(last, [key, "_stretch"], "full")
        .select(key, "_stretch", F.max("_last").over(earlier).alias("_opening"))
        .where(F.col("_opening").isNotNull())
    )
    # A snapshot counts for requests of its own instant too.
    marked = own.withColumn("_own", F.lit(1)).unionByName(dated.withColumn("_own", F.lit(0)), allowMissingColumns=True)
    upto = W.partitionBy(key, "_stretch").orderBy("_time", "_own").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = marked.withColumn("_seen", F.max(F.when(F.col("_own") == 0, F.col("_time"))).over(upto)).where("_own = 1")
    found = seen.join(opening, [key, "_stretch"], "left").withColumn(taken, F.coalesce("_seen", "_opening"))
    known = F.col(key).isNotNull() & F.col("_time").isNotNull()
    return found.select(*requests.columns, F.when(known, F.col(taken)).alias(taken))
