"""Bodies to registry in one stream: what batches give, after failures between any two steps."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from platenlog.operators.jobs import assign_job_ids, job_lookup, register_jobs
from platenlog.sources.messages import read_message_stream
from platenlog.streaming import intake, registry
from platenlog.streaming.admission import judged_messages
from tests.messages import CHARSET, LANGUAGE, attr, message
from tests.test_requests import NOON
from tests.test_streams import URI, arrive, rows_of

SCHEMA = (
    "seq BIGINT, session_id STRING, arrived_at TIMESTAMP, avail_bytes BIGINT, body BINARY, method STRING, path STRING, "
    "content_type STRING"
)


def some_messages(count, start, seed):
    draw, rows = random.Random(seed), []
    for seq in range(start, start + count):
        parts = [b"\x01", CHARSET, LANGUAGE, attr(0x42, "job-name", f"job {seq}".encode())]
        if draw.random() < 0.3:
            parts.append(attr(0x49, "document-format", draw.choice([b"application/pdf", b"image/urf"])))
        if draw.random() < 0.5:
            parts.append(attr(0x21, "job-id", draw.randrange(1, 9).to_bytes(4, "big")))
        body = message(draw.choice([2, 2, 2, 9, 11, 18]), *parts, document=draw.choice([b"", b"pdf " * 40]))
        if draw.random() < 0.2:
            body = body[: draw.randrange(len(body) // 2)]
        method = draw.choice(["POST"] * 9 + ["GET"])
        rows.append((seq, draw.choice(["hot", "hot", "s1"]), NOON, None, bytearray(body), method, "/ipp/print", "application/ipp"))
    return rows


def test_capture_survives_failures(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / d) for d in ("in", "out", "cp"))
    rows = []
    for k in range(3):
        more = some_messages(40, 40 * k, k)
        if k == 1:
            # A batch of which nothing is let through.
            more = [(*r[:5], "GET", *r[6:]) for r in more]
        arrive(spark, more, source, SCHEMA)
        rows += more
    failures = {(0, "a"), (1, "b"), (2, "a"), (2, "b")}

    def stumble(at):
        def step(batch, batch_id):
            if (batch_id, at) in failures:
                failures.discard((batch_id, at))
                raise RuntimeError("once")

        return step

    def run():
        stream = read_message_stream(spark, source, SCHEMA, max_files=1)
        intake.stream_capture(stream, path, checkpoint, stumble("a"), registry.lookup_step(spark, path, URI), stumble("b")).awaitTermination()

    for _ in range(4):
        with pytest.raises(StreamingQueryException):
            run()
    run()
    assert not failures

    judged = judged_messages(spark.createDataFrame(rows, SCHEMA))
    sound = judged.where("http_status = 200")
    jobs = register_jobs(assign_job_ids(sound))
    assert rows_of(registry.jobs_table(spark, path).drop("batch_id")) == rows_of(jobs) != []
    bad = judged.where("error is not null").select("seq", "session_id", "arrived_at", "error", "body")
    assert rows_of(intake.rejects(spark, path).drop("batch_id")) == rows_of(bad) != []
    refused = intake.intake_rows(spark, path, intake.REFUSED)
    assert rows_of(refused.select("seq", "http_status")) == rows_of(judged.where("http_status = 404").select("seq", "http_status"))
    answers = spark.read.schema(registry.ANSWERS).parquet(f"{path}/answers").drop("batch_id")
    assert rows_of(answers) == rows_of(job_lookup(sound, jobs, F.lit(URI)))
    held = intake.documents(spark, path)
    assert rows_of(held.select("session_id", "file_name", F.length("payload").alias("n"))) == rows_of(
        jobs.select("session_id", "file_name", F.col("size_bytes").alias("n"))
    )
    # Nothing but the batch's own requests is in a plan that reads them, and no body.
    plan = intake.intake_rows(spark, path, intake.REQUEST, 0).select("seq")._jdf.queryExecution().executedPlan().toString()
    assert "held" not in plan.split("ReadSchema")[1] and plan.count("FileScan") == 1
