"""Gate, admission, job ids, registry and look-ups."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from platenlog.functions import codes
from platenlog.operators.admission import admission, gate
from platenlog.operators.jobs import assign_job_ids, job_lookup, print_answers, register_jobs
from platenlog.operators.ordering import rank_within, running_sum

SCHEMA = (
    "seq BIGINT, session_id STRING, arrived_at TIMESTAMP, op_code INT, job_name STRING, user_name STRING, "
    "document_format STRING, doc_bytes BIGINT, lookup_job_id BIGINT, avail_bytes BIGINT"
)
NOON = dt.datetime(2024, 1, 1, 12)
PDF = "application/pdf"


def request(seq, op=2, session="s", name="Job", user="u", form=PDF, size=5000, look=None, avail=None):
    return (seq, session, NOON + dt.timedelta(seconds=seq % 86400), op, name, user, form, size, look, avail)


def test_gate_order(spark):
    limit = codes.MAX_BODY_BYTES
    cases = [
        (("GET", "/ipp/print", "application/ipp", 1), 404),
        (("POST", "/other", None, limit + 1), 404),
        (("POST", "/", None, 1), 400),
        (("POST", "/", "text/html", limit + 1), 400),
        (("POST", "/ipp/print", "application/ippx", limit), 200),
        (("POST", "/ipp/print", "application/ipp", limit + 1), 413),
        ((None, None, None, None), 404),
    ]
    frame = spark.createDataFrame([c + (i,) for i, (c, _) in enumerate(cases)], "method STRING, path STRING, content_type STRING, body_bytes BIGINT, i INT")
    got = {r.i: r.http_status for r in gate(frame).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    frame = frame.withColumn("read_ok", F.lit(False)).withColumn("reject_reason", F.lit("end-of-data"))
    got = [r.http_status for r in gate(frame).orderBy("i").collect()]
    assert got == [404, 404, 400, 400, 500, 500, 404]


def test_admission_rules(spark):
    need = 2 * 5000 + codes.SPACE_HEADROOM
    cases = {
        1: (dict(), 0),
        2: (dict(form=None), 0),
        3: (dict(form="application/PDF"), 0x040A),
        4: (dict(form="image/urf", size=0), 0x040A),
        5: (dict(size=0, avail=0), 0x0400),
        6: (dict(avail=need - 1), 0x0500),
        7: (dict(avail=need), 0),
        8: (dict(op=4, form="image/urf", size=0), 0),
        9: (dict(op=9), 0x0400),
        10: (dict(op=9, look=-1), 0),
        11: (dict(op=11), 0),
        12: (dict(op=5), 0x0501),
        13: (dict(op=None), 0x0501),
        14: (dict(form="application/octet-stream"), 0),
        15: (dict(size=None), 0x0400),
        16: (dict(form="application/postscript"), 0x040A),
        17: (dict(size=2**62, avail=None), 0),
    }
    frame = spark.createDataFrame([request(seq, **kw) for seq, (kw, _) in cases.items()], SCHEMA)
    got = {r.seq: (r.status, r.reason) for r in admission(frame).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: want for k, (_, want) in cases.items()}
    assert got[11][1] is None and got[8][1] == "successful-ok"
    bare = admission(frame.withColumn("has_group", F.lit(False)))
    got = {r.seq: r.status for r in bare.collect()}
    assert (got[1], got[4], got[8], got[10], got[11], got[12]) == (0x0400, 0x0400, 0, 0x0400, 0, 0x0501)
    unwritten = {r.seq: r.reason for r in admission(frame.withColumn("write_ok", F.lit(False))).collect()}
    assert unwritten[1] == "Failed to save document" and unwritten[6] == "Insufficient storage space"


def test_refused_print_leaves_a_gap_and_repeats_are_new_jobs(spark):
    rows = [
        request(1), request(2, avail=0), request(3), request(3 + 2**40), request(9, session="t", name=None, user=None),
        request(10, size=0), request(11, form="image/jpeg"), request(12, name="", user=""),
    ]
    numbered = assign_job_ids(spark.createDataFrame(rows, SCHEMA))
    jobs = {(r.session_id, r.created_seq): r for r in register_jobs(numbered).collect()}
    assert {k: v.job_id for k, v in jobs.items()} == {("s", 1): 1, ("s", 3): 3, ("s", 12): 4, ("s", 3 + 2**40): 5, ("t", 9): 1}
    t = jobs["t", 9]
    assert (t.name, t.originating_user, t.file_name) == ("Untitled", "unknown", f"{t.time_created}_1_Untitled.pdf")
    assert jobs["s", 12].name == "" and jobs["s", 12].file_name.endswith("_4_.pdf")


@pytest.mark.parametrize("block_bits", [0, 3, 20])
def test_ids_of_a_hot_session(spark, block_bits):
    rng = random.Random(3)
    rows = [
        request(seq, session="hot" if rng.random() < 0.4 else f"s{rng.randrange(30)}", size=rng.choice([0, 10]), avail=rng.choice([None, 0]))
        for seq in rng.sample(range(5000), 2000)
    ]
    want, last = {}, {}
    for r in sorted(rows):
        if r[7] > 0:
            last[r[1]] = last.get(r[1], 0) + 1
            want[r[0]] = last[r[1]]
    got = {r.seq: r.job_id for r in assign_job_ids(spark.createDataFrame(rows, SCHEMA), block_bits).collect()}
    assert got == want


def test_running_sum_of_any_amount_and_negative_positions(spark):
    rng = random.Random(4)
    rows = [(k, p, rng.randrange(-3, 4)) for k in "abc" for p in rng.sample(range(-300, 300), 200)]
    want, total = {}, {}
    for k, p, v in sorted(rows):
        total[k] = total.get(k, 0) + v
        want[k, p] = total[k]
    frame = spark.createDataFrame(rows, "k STRING, p BIGINT, v INT")
    got = running_sum(frame, ["k"], "p", F.col("v"), "total", block_bits=4).collect()
    assert {(r.k, r.p): r.total for r in got} == want


def test_ids_go_on_from_those_drawn(spark):
    rows = [request(seq, session="ab"[seq % 2]) for seq in range(40)]
    drawn = spark.createDataFrame([("a", 100), ("c", 7)], "session_id STRING, last_id BIGINT")
    for bits in (2, 20):
        got = {r.seq: r.job_id for r in assign_job_ids(spark.createDataFrame(rows, SCHEMA), bits, drawn).collect()}
        assert got == {seq: seq // 2 + 1 + (100 if seq % 2 == 0 else 0) for seq in range(40)}


def test_rank_of_a_hot_key_with_ties(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", rng.randrange(4), f"n{i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "k STRING, m INT, n STRING").repartition(8)
    got = {(r.k, r.n): r.place for r in rank_within(frame, ["k"], [F.desc("m"), F.asc("n")], "place").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), start=1):
            want[k, r[2]] = i
    assert got == want


def test_lookups(spark):
    rows = [
        request(1, name="First", size=500), request(2, size=1025), request(3, op=9, look=1), request(4, op=9, look=2), request(5, op=9, look=3),
        request(6), request(7, op=9, look=3), request(8, op=9), request(9, op=9, session="t", look=1), request(10, op=9, look=-1),
    ]
    log = spark.createDataFrame(rows, SCHEMA)
    jobs = register_jobs(assign_job_ids(log))
    got = {r.seq: r for r in job_lookup(log, jobs, F.lit("ipp://h:1/ipp/print")).collect()}
    assert {k: r.status for k, r in got.items()} == {3: 0, 4: 0, 5: 0x0406, 7: 0, 8: 0x0400, 9: 0x0406, 10: 0x0406}
    first = got[3]
    assert (first.job_id, first.job_uri, first.state, first.job_name, first.k_octets) == (1, "ipp://h:1/ipp/print/jobs/1", 9, "First", 1)
    assert got[4].k_octets == 1 and got[5].k_octets is None and got[5].job_uri is None
    assert (got[8].reason, got[9].reason) == ("Missing job-id", "Job not found")


def test_huge_values_wrap(spark):
    jobs = spark.createDataFrame(
        [("s", 4294967295, 1, 9, "n", "u", 4294967301, "f", 2**44)],
        "session_id STRING, job_id BIGINT, created_seq BIGINT, state INT, name STRING, originating_user STRING, time_created BIGINT, file_name STRING, size_bytes BIGINT",
    )
    log = spark.createDataFrame([request(5, op=9, look=-1)], SCHEMA)
    r = job_lookup(log, jobs, F.lit("p")).collect()[0]
    assert (r.status, r.job_id, r.time_at_creation, r.k_octets) == (0, -1, 5, 0)


def test_print_answers(spark):
    log = spark.createDataFrame([request(1), request(2, avail=0), request(3, size=0), request(4, op=4), request(5)], SCHEMA)
    got = {r.seq: (r.status, r.job_id, r.state) for r in print_answers(log, F.lit("p")).collect()}
    assert got == {1: (0, 1, 9), 2: (0x0500, None, None), 3: (0x0400, None, None), 5: (0, 3, 9)}


def test_hot_lookup_is_split(spark):
    """One job asked for by most look-ups: adaptive execution splits its side of the join."""
    size, conf = 60000, {
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
        log = spark.range(0, size, 1, 8).select(
            k.alias("seq"), F.lit("s").alias("session_id"), F.lit(9).alias("op_code"),
            F.when(k % 3 > 0, 7).otherwise(k % 500 + 1).cast("bigint").alias("lookup_job_id"),
            F.lit(PDF).alias("document_format"), F.lit(0).cast("bigint").alias("doc_bytes"), F.lit(None).cast("bigint").alias("avail_bytes"),
        )
        jobs = spark.range(1, 401, 1, 4).select(
            F.lit("s").alias("session_id"), k.alias("job_id"), F.lit(-1).cast("bigint").alias("created_seq"), F.lit(9).alias("state"),
            F.lit("n").alias("name"), F.lit("u").alias("originating_user"), k.alias("time_created"), F.lit("f").alias("file_name"), k.alias("size_bytes"),
        )
        answers = job_lookup(log, jobs, F.lit("p"))
        rows = answers.collect()
        assert len(rows) == size and sum(r.status == 0 for r in rows) == sum(
            1 for i in range(size) if i % 3 > 0 or i % 500 + 1 <= 400
        )
        assert "skew=true" in answers._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
