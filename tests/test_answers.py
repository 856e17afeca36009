"""Answers from long tables, as of the request's time, against plain look-ups."""

import random
from bisect import bisect_right

from pyspark.sql import functions as F

from platenlog.operators import answers
from platenlog.plans import reports

LONG = "device_id BIGINT, pos INT, name STRING, value_pos INT, tag INT, value STRING"


def test_attribute_answers(spark):
    held = spark.createDataFrame(
        [(1, 1, "a", 1, 66, "x"), (1, 1, "a", 2, 66, "y"), (1, 2, "b", 1, 33, "1"), (2, 1, "a", 1, 66, "z")], LONG
    )
    asked = spark.createDataFrame(
        [(1, 1, None), (2, 1, ["a", "a", "none"]), (3, 1, ["b", "all"]), (4, 2, []), (5, 9, None), (6, None, None), (7, None, ["a"]), (8, 2, ["b"])],
        "seq BIGINT, device_id BIGINT, wanted ARRAY<STRING>",
    )
    got = sorted((r.seq, r.name, r.value_pos, r.value) for r in answers.attribute_answers(asked, held).collect())
    both = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "1")]
    assert got == [*((1, *r) for r in both), (2, "a", 1, "x"), (2, "a", 2, "y"), *((3, *r) for r in both), (4, "a", 1, "z")]
    assert answers.attribute_answers(asked.limit(0), held).count() == 0


def test_as_of_equals_plain(spark):
    """A hot device, devices without snapshots, ties, nulls, stretches far apart."""
    draw = random.Random(8)
    devices = ["hot"] * 5 + ["a", "b", "none"]
    snapshots = [(draw.choice(devices[:-1]), draw.randrange(2_000_000)) for _ in range(150)]
    snapshots += snapshots[:20] + [("late", 5_000_000), (None, 3), ("a", None)]
    asked = [(k, draw.choice(devices), draw.randrange(2_100_000)) for k in range(900)]
    asked += [(k + 900, d, t) for k, (d, t) in enumerate(snapshots[:30])]
    asked += [(2000, "late", 4_999_999), (2001, "late", 5_000_000), (2002, None, 5), (2003, "a", None), (2004, "late", 90_000_000)]

    def times(column):
        return F.timestamp_micros(F.col(column) * 100_000)

    requests = spark.createDataFrame(asked, "seq BIGINT, device_id STRING, t BIGINT").withColumn("arrived_at", times("t"))
    held = spark.createDataFrame(snapshots, "device_id STRING, t BIGINT").select("device_id", times("t").alias("taken_at"))
    by_device = {}
    for device, t in snapshots:
        if device is not None and t is not None:
            by_device.setdefault(device, set()).add(t)
    want = {}
    for seq, device, t in asked:
        known = sorted(by_device.get(device, ()))
        at = bisect_right(known, t) if t is not None else 0
        want[seq] = known[at - 1] if at else None
    for stretch in (1, 3600, 10**7):
        found = answers.as_of(requests, held, stretch=stretch)
        assert found.columns == [*requests.columns, "taken_at"]
        got = {r.seq: r.us // 100_000 if r.us is not None else None for r in found.select("seq", F.unix_micros("taken_at").alias("us")).collect()}
        assert got == want


def test_much_asked_device_is_split(spark):
    """Most requests ask one device: adaptive execution splits its side of both joins."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        k = F.col("id")
        device = F.when(k % 3 > 0, 7).otherwise(k % 500)
        wanted = F.when(k % 2 == 0, F.array(F.lit("n3"), F.lit("n5")))
        asked = spark.range(0, 60000, 1, 8).select(k.alias("seq"), device.alias("device_id"), wanted.alias("wanted"))
        held = spark.range(0, 500 * 10, 1, 4).select(
            (k % 500).alias("device_id"), F.floor(k / 500).cast("int").alias("pos"), F.concat(F.lit("n"), F.floor(k / 500)).alias("name"),
            F.lit(1).alias("value_pos"), F.lit(66).alias("tag"), F.lit("v").alias("value"),
        )
        told = answers.attribute_answers(asked, held)
        assert len(told.collect()) == 30000 * 2 + 30000 * 10
        assert told._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin(skew=true)") >= 2
    finally:
        for key, v in before.items():
            spark.conf.set(key, v) if v is not None else spark.conf.unset(key)


def test_only_snapshots_that_answer_are_laid_out(spark, monkeypatch):
    """Devices that nobody asks, and times that no request falls to, cost no attribute rows."""
    laid, made = [], reports.explode_devices

    def seen(snapshots):
        laid.append(snapshots.count())
        return made(snapshots)

    monkeypatch.setattr(reports, "explode_devices", seen)
    told = reports.dated_answers(spark, "/root/testdata/sf0.01")
    meant = told.select("device_id", "taken_s").distinct().count()
    customers = spark.read.parquet("/root/testdata/sf0.01/customer.parquet").count()
    asking = reports.asking_rows(spark, "/root/testdata/sf0.01").count()
    assert 0 < meant <= laid[0] <= min(asking, 3 * customers - 1)
