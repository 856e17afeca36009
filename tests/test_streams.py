"""Streams give what batches give, over several micro-batches, after a restart and after a replay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from platenlog.operators.catalogue import page
from platenlog.operators.jobs import assign_job_ids, job_lookup, register_jobs
from platenlog.operators.presence import presence_intervals
from platenlog.sources.documents import notify_jobs
from platenlog.sources.messages import read_message_stream
from platenlog.streaming import registry, runs
from platenlog.streaming.admission import judged_messages, stream_admission
from platenlog.plans.session import STREAM_SETTINGS
from platenlog.streaming.presence import stream_presence, stream_presence_changes
from tests.messages import CHARSET, attr, message
from tests.test_requests import NOON, SCHEMA

URI = "ipp://h:1/ipp/print"


def some_requests(count, start=0, seed=1):
    rng = random.Random(seed)
    rows = []
    for seq in range(start, start + count):
        session = "hot" if rng.random() < 0.5 else f"s{rng.randrange(4)}"
        size = rng.choice([0, 10, 5000])
        rows.append((
            seq, session, NOON + dt.timedelta(seconds=seq), rng.choice([2, 2, 2, 9, 4, 18]), f"job {seq}", "u",
            rng.choice(["application/pdf", None, "image/urf"]), size, rng.randrange(1, 40), rng.choice([None, 0]), bytearray(b"x" * size),
        ))
    return rows


PAYLOAD_SCHEMA = SCHEMA + ", payload BINARY"


def arrive(spark, rows, path, schema=PAYLOAD_SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def rows_of(frame):
    return sorted((tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    """Two runs on one checkpoint, three and then two micro-batches."""
    base = str(tmp_path_factory.mktemp("served"))
    source, path, checkpoint = f"{base}/in", f"{base}/out", f"{base}/cp"
    rows, told = [], []

    def run(batches):
        for _ in range(batches):
            more = some_requests(60, start=len(rows), seed=len(rows))
            arrive(spark, more, source)
            rows.extend(more)
        stream = read_message_stream(spark, source, PAYLOAD_SCHEMA, max_files=1)
        registry.run_steps(
            stream,
            checkpoint,
            registry.registry_step(spark, path),
            registry.archive_step(spark, path),
            registry.lookup_step(spark, path, URI),
            registry.listing_step(spark, path),
            registry.notify_step(path, lambda df, i: told.extend((i, r.job_id, r.session_id) for r in df.collect())),
        ).awaitTermination()

    run(3)
    run(2)
    return spark.createDataFrame(rows, PAYLOAD_SCHEMA), path, told


def test_registry_equals_batch(spark, served):
    log, path, told = served
    jobs = registry.jobs_table(spark, path)
    batch = register_jobs(assign_job_ids(log))
    assert rows_of(jobs.drop("batch_id")) == rows_of(batch)
    assert {r.batch_id for r in jobs.select("batch_id").distinct().collect()} == {0, 1, 2, 3, 4}
    assert sorted((j, s) for _, j, s in told) == sorted((r.job_id, r.session_id) for r in batch.collect())


def test_lookups_equal_batch(spark, served):
    log, path, _ = served
    answers = spark.read.schema(registry.ANSWERS).parquet(f"{path}/answers").drop("batch_id")
    batch = job_lookup(log, register_jobs(assign_job_ids(log)), F.lit(URI))
    assert rows_of(answers) == rows_of(batch)
    assert {r.status for r in answers.collect()} == {0, 0x0406}


def test_archive_and_listing_equal_batch(spark, served):
    log, path, _ = served
    batch = register_jobs(assign_job_ids(log))
    archive = registry.archive_table(spark, path)
    assert rows_of(archive.select("file_name", "session_id", F.length("payload").alias("n"))) == rows_of(
        batch.select("file_name", "session_id", F.col("size_bytes").alias("n"))
    )
    files = archive.select("session_id", "file_name", "size_bytes", "modified")
    assert rows_of(registry.newest_page(spark, path)) == rows_of(page(files, 0).drop("page", "pages"))


def test_replay_changes_nothing(spark, served, tmp_path):
    path = str(tmp_path / "out")
    steps = [registry.registry_step(spark, path), registry.archive_step(spark, path), registry.lookup_step(spark, path, URI), registry.listing_step(spark, path)]
    batches = [spark.createDataFrame(some_requests(40, 40 * i, i), PAYLOAD_SCHEMA) for i in range(3)]

    def tables():
        return [rows_of(spark.read.parquet(f"{path}/{t}")) for t in ("draws", "answers", "archive")] + [rows_of(registry.newest_page(spark, path))]

    for batch_id in (0, 1, 1, 2):
        for step in steps:
            step(batches[batch_id], batch_id)
    once = tables()
    for step in steps:
        step(batches[2], 2)
    assert tables() == once
    # A batch that failed between its steps and is run again.
    steps[0](batches[2], 2)
    for step in steps:
        step(batches[2], 2)
    assert tables() == once


def test_quiet_batches_keep_counters(spark, tmp_path):
    path = str(tmp_path / "out")
    step = registry.registry_step(spark, path)
    make = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    job = lambda seq, **kw: (seq, "s", NOON, kw.get("op", 2), "n", "u", None, 5, None, kw.get("avail"))
    step(make(job(1), job(2, avail=0)), 0)
    for batch_id in range(1, 2 * runs.BASE):
        step(make(job(10 + batch_id, op=4)), batch_id)
    step(make(job(90), job(91)), 2 * runs.BASE)
    assert sorted((r.created_seq, r.job_id) for r in registry.jobs_table(spark, path).collect()) == [(1, 1), (90, 3), (91, 4)]


def test_first_batches_without_jobs(spark, tmp_path):
    path = str(tmp_path / "out")
    steps = [registry.registry_step(spark, path), registry.listing_step(spark, path), registry.lookup_step(spark, path, URI)]
    quiet = spark.createDataFrame([(1, "s", NOON, 9, "n", "u", None, 5, 1, None)], SCHEMA)
    for step in steps:
        step(quiet, 0)
    assert registry.jobs_table(spark, path).count() == 0 and registry.newest_page(spark, path).count() == 0
    assert spark.read.schema(registry.ANSWERS).parquet(f"{path}/answers").first().status == 0x0406


def append_all(stream, path, checkpoint):
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_admission_stream_equals_batch(spark, tmp_path):
    bodies = [
        message(2, b"\x01", CHARSET, document=b"pdf"), message(2, b"\x01", attr(0x49, "document-format", b"image/urf"), document=b"x"),
        message(2, b"\x01", end=b""), message(0x12, b"\x01"), message(2, b"\x02", document=b"x"), b"", message(9, b"\x01", attr(0x21, "job-id", b"\0\0\0\1")),
    ]
    source, schema = str(tmp_path / "in"), "seq BIGINT, body BINARY, avail_bytes BIGINT"
    for i, body in enumerate(bodies):
        arrive(spark, [(i, bytearray(body), None)], source, schema)
    append_all(stream_admission(read_message_stream(spark, source, schema, max_files=2)), str(tmp_path / "out"), str(tmp_path / "cp"))
    columns = ["seq", "http_status", "status", "reason"]
    got = rows_of(spark.read.parquet(str(tmp_path / "out")).select(columns))
    assert got == rows_of(judged_messages(spark.read.parquet(source)).select(columns))
    assert {r[2]: r[3] for r in got} == {0: 0, 1: 0x040A, 2: None, 3: 0x0501, 4: 0x0400, 5: None, 6: 0}


def test_presence_stream(spark, tmp_path):
    second = 10**6
    rng = random.Random(9)
    heard = [("exact", 0), ("exact", 120 * second), ("near", 0), ("near", 120 * second - 1)]
    heard += [(f"d{rng.randrange(3)}", rng.randrange(3000) * second) for _ in range(200)]
    heard.sort(key=lambda h: h[1])
    end = 10**5 * second
    source, schema = str(tmp_path / "in"), "device_id STRING, ts TIMESTAMP"
    frames = []
    for i in range(0, len(heard), 60):
        frame = spark.createDataFrame(heard[i : i + 60], "device_id STRING, us BIGINT").select("device_id", F.timestamp_micros("us").alias("ts"))
        frame.coalesce(1).write.mode("append").parquet(source)
        frames.append(frame)
    # A much later announcement moves the watermark past every span.
    spark.createDataFrame([("late", end)], "device_id STRING, us BIGINT").select("device_id", F.timestamp_micros("us").alias("ts")).coalesce(1).write.mode("append").parquet(source)
    append_all(stream_presence(read_message_stream(spark, source, schema, max_files=1)), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = presence_intervals(spark.read.schema(schema).parquet(source)).drop("span").where("device_id <> 'late'")
    assert rows_of(got) == rows_of(want)
    assert got.where("device_id = 'exact'").count() == 2 and got.where("device_id = 'near'").count() == 1


def test_presence_changes(spark, tmp_path):
    """On and off as the watermark settles them: out of order, across a restart, and at exactly one lifetime."""
    second = 10**6
    rng = random.Random(5)
    heard = [("exact", 0), ("exact", 120 * second), ("near", 1), ("near", 120 * second), ("back", 500 * second), ("back", 400 * second), ("back", 300 * second)]
    heard += [(f"d{rng.randrange(3)}", rng.randrange(3000) * second + rng.randrange(second)) for _ in range(300)]
    # After the epoch, where the watermark begins; up to 100 seconds late.
    heard = [(d, us + 1000 * second) for d, us in heard]
    heard.sort(key=lambda h: h[1] + rng.randrange(100) * second)
    end = 6000 * second
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "cp"))
    schema = "device_id STRING, ts TIMESTAMP"

    def come(rows):
        spark.createDataFrame(rows, "device_id STRING, us BIGINT").select("device_id", F.timestamp_micros("us").alias("ts")).coalesce(1).write.mode("append").parquet(source)

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STREAM_SETTINGS[key])
    try:
        told = []
        for at in (0, 150):
            for k in range(at, min(at + 150, len(heard)), 75):
                come(heard[k : k + 75])
            append_all(stream_presence_changes(read_message_stream(spark, source, schema, max_files=1)), out, checkpoint)
            told.append(spark.read.parquet(out).count())
        come(heard[300:] + [("late", end)])
        append_all(stream_presence_changes(read_message_stream(spark, source, schema, max_files=1)), out, checkpoint)
    finally:
        spark.conf.set(key, before)
    spans = presence_intervals(spark.read.schema(schema).parquet(source)).where("device_id <> 'late'")
    on = spans.select("device_id", F.lit("online").alias("change"), F.col("online_from").alias("at"), "online_from", F.lit(None).cast("long").alias("announcements"))
    off = spans.select("device_id", F.lit("offline").alias("change"), F.col("offline_at").alias("at"), "online_from", "announcements")
    got = spark.read.parquet(out)
    assert 0 < told[0] < told[1] < got.count()
    assert rows_of(got) == rows_of(on.unionByName(off))
    assert {d: got.where(f"device_id = '{d}'").count() for d in ("exact", "near", "back")} == {"exact": 4, "near": 2, "back": 2}
    # One row for each device that is not settled.
    state = spark.read.format("statestore").option("stateVarName", "spans").load(checkpoint)
    assert [r.key[0] for r in state.select("key").collect()] == ["late"]


def test_notices_of_a_stream(spark, tmp_path):
    source, told = str(tmp_path / "in"), []
    for i in range(3):
        arrive(spark, [("s", i, f"{i}.pdf", 9)], source, "session_id STRING, job_id BIGINT, file_name STRING, size_bytes BIGINT")
    stream = read_message_stream(spark, source, "session_id STRING, job_id BIGINT, file_name STRING, size_bytes BIGINT", max_files=1)
    notify_jobs(stream, "/d", lambda df, i: told.extend(r.file_path for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert told == ["/d/0.pdf", "/d/1.pdf", "/d/2.pdf"]


def registry_of(spark, source, path, checkpoint, *more):
    stream = read_message_stream(spark, source, PAYLOAD_SCHEMA, max_files=1)
    registry.run_steps(stream, checkpoint, registry.registry_step(spark, path), *more).awaitTermination()


def test_new_checkpoint_is_refused(spark, tmp_path):
    """It would write batch 0 over the jobs of the first stream and issue their ids again."""
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(2):
        arrive(spark, some_requests(30, 30 * i, i), source)
    registry_of(spark, source, path, str(tmp_path / "cp"))
    before = rows_of(registry.draws_table(spark, path))
    arrive(spark, some_requests(10, 60, 9), source)
    with pytest.raises(Exception, match="new checkpoint needs new tables"):
        registry_of(spark, source, path, str(tmp_path / "other"))
    assert rows_of(registry.draws_table(spark, path)) == before
    # The first one goes on.
    registry_of(spark, source, path, str(tmp_path / "cp"))
    assert len(rows_of(registry.draws_table(spark, path))) > len(before)


def test_listing_added_later_is_complete(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / d) for d in ("in", "out", "cp"))
    rows = some_requests(80)
    arrive(spark, rows[:60], source)
    registry_of(spark, source, path, checkpoint)
    arrive(spark, rows[60:], source)
    registry_of(spark, source, path, checkpoint, registry.listing_step(spark, path))
    files = register_jobs(assign_job_ids(spark.createDataFrame(rows, PAYLOAD_SCHEMA))).withColumn(
        "modified", F.timestamp_seconds("time_created")
    ).select("session_id", "file_name", "size_bytes", "modified")
    assert rows_of(registry.newest_page(spark, path)) == rows_of(page(files, 0).drop("page", "pages"))


def test_checkpoint_put_back(spark, tmp_path):
    """Ten batches back, further than snapshots are kept: the same tables again."""
    path = str(tmp_path / "out")
    steps = [registry.registry_step(spark, path), registry.listing_step(spark, path)]
    batches = [spark.createDataFrame(some_requests(12, 12 * i, i), PAYLOAD_SCHEMA) for i in range(12)]

    def run(first):
        for i in range(first, len(batches)):
            for step in steps:
                step(batches[i], i)
        return rows_of(registry.draws_table(spark, path)), rows_of(registry.newest_page(spark, path))

    assert run(0) == run(2)


def test_presence_changes_asks_its_state_little():
    """One read, one write and a timer only where it moves, for each device and batch; no empty frames."""
    import pandas as pd

    from platenlog.streaming.presence import _Changes

    calls = []

    class Handle:
        value = None

        def getValueState(self, *_):
            return self

        def __getattr__(self, name):
            def call(*given):
                calls.append(name)
                if name == "update":
                    self.value = given[0]
                return self.value if name == "get" else None

            return call

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 0

    own = _Changes(60)
    own.init(Handle())
    for us in (5_000_000, 6_000_000):
        assert list(own.handleInputRows(("d",), [pd.DataFrame({"us": [us]})], Clock())) == []
    assert calls == ["get", "registerTimer", "update", "get", "update"]
