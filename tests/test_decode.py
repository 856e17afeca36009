"""Decoding: the named bodies, the cases that are easily got wrong, and random bodies against a plain reading."""

import os
import random
import time
import struct
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platenlog.operators.attributes import explode_attributes, typed_values
from platenlog.operators.decode import PREFIXES, decode_messages, document_tail, request_columns, split_rejects
from platenlog.operators import walk
from platenlog.operators.walk import read_headers
from platenlog.sources.messages import read_messages
from platenlog.streaming.admission import judged_messages
from tests.messages import CHARSET, LANGUAGE, URI, attr, message, plain_read

TOKEN = ("group_pos", "delimiter", "pos", "attr_pos", "value_pos", "tag", "name", "value")


def read(bodies, prefix=None):
    totals = pa.array([len(b) for b in bodies], pa.int64())
    return read_headers(pa.array([b[:prefix] for b in bodies], pa.binary()), totals)


def walked(bodies, prefix=None):
    return read(bodies, prefix).to_pylist()


def with_names(tokens):
    """Tokens as the plain reading shows them: values added to an attribute under its name."""
    names = {t["attr_no"]: t["name"] for t in tokens if t["value_pos"] == 1}
    return [tuple(names.get(t["attr_no"], "") if f == "name" else t[f] for f in TOKEN) for t in tokens]


def as_plain(row):
    if row["reason"] == "end-of-data":
        return ("end-of-data", row["need"], row["have"])
    if row["reason"] is not None:
        return (row["reason"],)
    fixed = (row["major"], row["minor"], row["code"], row["request_id"])
    return fixed, row["header_len"], row["groups"], with_names(row["tokens"])


def random_body(rng):
    tags = [0x10, 0x12, 0x13, 0x21, 0x22, 0x23, 0x30, 0x31, 0x32, 0x33, 0x34, 0x35, 0x37, 0x41, 0x42, 0x44, 0x49, 0x4A, 0x99]
    parts = []
    for _ in range(rng.randrange(6)):
        roll = rng.random()
        if roll < 0.3:
            parts.append(bytes([rng.choice([1, 2, 4, 5])]))
        elif roll < 0.33:
            parts.append(bytes([rng.choice([0, 6, 10, 15])]))
        else:
            name = rng.choice(["", "", "job-name", "é", "x" * 40]).encode()
            if rng.random() < 0.04:
                name = b"\xff" + name
            value = rng.choice([b"", b"\x01", b"abc", b"\0\0\0\x07", b"\x80\0\0\0\0\0\0\1", b"0123456789ab", "ñ".encode()])
            if rng.random() < 0.04:
                value = b"\xed\xa0\x80"
            parts.append(attr(rng.choice(tags), name, value))
    body = message(rng.randrange(0x10000), b"\x01" if rng.random() < 0.9 else b"", *parts, document=rng.randbytes(rng.randrange(9)))
    return body[: rng.randrange(len(body) + 1)] if rng.random() < 0.4 else body


def test_walk_equals_plain_reading():
    rng = random.Random(7)
    bodies = [random_body(rng) for _ in range(4000)] + [rng.randbytes(rng.randrange(40)) for _ in range(500)]
    for body, row in zip(bodies, walked(bodies)):
        assert as_plain(row) == plain_read(body), body


def long_body(rng, items):
    """A header of many items: values, added values, new groups, collections; sound, cut, or with a fault."""
    parts = [b"\x01"]
    for _ in range(items):
        roll = rng.random()
        if roll < 0.03:
            parts.append(bytes([rng.choice([1, 2, 4, 5])]))
        elif roll < 0.5:
            parts.append(attr(rng.choice([0x21, 0x42, 0x44, 0x30, 0x34, 0x37, 0x4A, 0x13]), rng.choice(["", "a", "name", "é" * 40]), b"\0\0\0" + bytes([rng.randrange(128)])))
        else:
            parts.append(attr(0x30, "", rng.randbytes(rng.choice([0, 1, 9, 300]))))
    if rng.random() < 0.3:
        parts[rng.randrange(1, items)] = rng.choice([attr(0x21, "short", b"x"), attr(0x42, b"\xff", b"x"), b"\x0a", b"\x03", attr(0x42, "n", b"\xc3")])
    body = message(2, *parts, document=rng.randbytes(rng.choice([0, 40, 3000])))
    return body[: rng.randrange(len(body) + 1)] if rng.random() < 0.3 else body


@pytest.mark.parametrize("turns, windows", [(1, (64, 64)), (2, (16, 4096)), (5, (1 << 14, 1 << 20))])
def test_leaps_equal_plain_reading(monkeypatch, turns, windows):
    rng = random.Random(turns)
    monkeypatch.setattr(walk, "TURNS", turns)
    monkeypatch.setattr(walk, "WINDOWS", windows)
    bodies = [long_body(rng, rng.randrange(2, 120)) for _ in range(300)] + [random_body(rng) for _ in range(1500)]
    for body, row in zip(bodies, walked(bodies)):
        assert as_plain(row) == plain_read(body), body


def test_a_million_items_in_seconds():
    item = attr(0x44, "", b"kw")
    body = message(2, b"\x01", attr(0x44, "requested-attributes", b"all"), *[item] * 1_000_000, document=b"doc")
    begun = time.perf_counter()
    whole = read([body])
    took = time.perf_counter() - begun
    tokens = whole.field("tokens").values
    assert whole.field("header_len")[0].as_py() == len(body) - 3 and len(tokens) == 1_000_001
    assert tokens.field("value_pos")[-1].as_py() == 1_000_001 and tokens.field("attr_no")[-1].as_py() == 1
    assert took < 30  # one by one it is minutes


def test_prefix_decides_as_the_whole_body_does_or_not_at_all():
    rng = random.Random(8)
    bodies = [random_body(rng) for _ in range(2000)]
    for prefix in (0, 5, 30, 4096):
        for body, row in zip(bodies, walked(bodies, prefix)):
            if row is None:
                assert len(body) > prefix
            else:
                assert as_plain(row) == plain_read(body), body
        sound = [b for b in bodies if len(plain_read(b)) == 4 and plain_read(b)[1] < prefix]
        assert None not in walked(sound, prefix)


def test_output_is_no_larger_than_input():
    """Many values under a long name: 84 KB, and 300 KB of which a copy of the name for each value would be 3.6 GB."""
    for name, count in ((60_000, 4_000), (60_000, 60_000)):
        values = attr(0x44, "", b"v") * (count - 1)
        body = message(2, b"\x01", attr(0x44, "n" * name, b"v"), values)
        whole = read([body])
        tokens = whole.field("tokens").values
        assert len(tokens) == count
        assert sum(tokens.field(c).nbytes for c in ("name", "value")) < 10 * len(body)
        assert tokens.field("attr_no").to_pylist()[-1] == 1 and tokens.field("value_pos").to_pylist()[-1] == count


def test_bad_texts_are_found_by_halves():
    bodies = [message(2, b"\x01", attr(0x42, "job-name", b"\xff" if k % 7 == 0 else b"ok")) for k in range(500)]
    assert [r["reason"] for r in walked(bodies)] == ["bad-utf8" if k % 7 == 0 else None for k in range(500)]


def test_sliced_batches():
    bodies = pa.array([message(2, b"\x01", CHARSET), b"", message(4, b"\x01", URI)], pa.binary())
    totals = pa.array([len(b) for b in bodies.to_pylist()], pa.int64())
    rows = read_headers(bodies.slice(1), totals.slice(1)).to_pylist()
    assert (rows[0]["need"], rows[0]["have"]) == (1, 0)
    assert [t["name"] for t in rows[1]["tokens"]] == ["printer-uri"]
    assert read_headers(bodies.slice(0, 0), totals.slice(0, 0)).to_pylist() == []


@pytest.fixture(scope="module")
def named(spark):
    pdf = b"%PDF-1.4 test"
    user = attr(0x42, "requesting-user-name", b"tester")
    bodies = {
        "ask": message(0x000B, b"\x01", CHARSET, LANGUAGE, URI),
        "tail": message(0x000B, b"\x01", CHARSET, LANGUAGE, URI, document=b"%PDF-1.4 fake document"),
        "typed": message(2, b"\x01", attr(0x21, "test-int", struct.pack(">i", 42)), attr(0x22, "test-bool", b"\x01")),
        "response": message(0, b"\x01", CHARSET, LANGUAGE, b"\x04", attr(0x42, "printer-name", b"P"),
                            attr(0x23, "printer-state", struct.pack(">i", 3)), version=(2, 0)),
        "multi": message(0, b"\x04", attr(0x49, "document-format-supported", b"application/pdf"), attr(0x49, "", b"image/urf")),
        "print": message(2, b"\x01", CHARSET, LANGUAGE, URI, attr(0x42, "job-name", b"Test"), user,
                         attr(0x49, "document-format", b"application/pdf"), document=pdf),
        "collection": message(0, b"\x04", attr(0x34, "media-col", b""), attr(0x4A, "", b"x"), attr(0x21, "", struct.pack(">i", 5)), attr(0x37, "", b"")),
        "orphan": message(2, b"\x01", attr(0x44, "", b"lost"), attr(0x44, "kept", b"v")),
        "zero": message(2, b"\x01", CHARSET, document=b"tail", end=b"\x00"),
        "newline": message(2, b"\x01", CHARSET, document=b"tail", end=b"\x0a"),
        "no-end": message(2, b"\x01", CHARSET, end=b""),
        "short-int": message(2, b"\x01", attr(0x21, "n", b"\0\0\1")),
        "long-int": message(2, b"\x01", attr(0x21, "n", b"\0\0\1\0\7\7")),
        "empty-bool": message(2, b"\x01", attr(0x22, "b", b"")),
        "bad-text": message(2, b"\x01", attr(0x42, "job-name", b"\xff\xfe")),
        "raw": message(2, b"\x01", attr(0x35, "a", b"\xff"), attr(0x36, "b", b"\xfe"), attr(0x99, "c", b"\xfd")),
        "duplicate": message(2, b"\x01", attr(0x44, "job-name", b"word"), attr(0x42, "job-name", b"Later")),
        "second-group": message(2, b"\x02", attr(0x42, "job-name", b"No"), b"\x01", attr(0x42, "job-name", b"Yes"), b"\x01", attr(0x42, "job-name", b"Late")),
        "no-group": message(2, b"\x02", attr(0x42, "job-name", b"No"), document=pdf),
        "empty-name": message(2, b"\x01", attr(0x42, "job-name", b""), document=pdf),
        "wanted": message(0x0B, b"\x01", attr(0x44, "requested-attributes", b"printer-name"), attr(0x42, "", b"no"), attr(0x44, "", b"media"), attr(0x44, "requested-attributes", b"sides")),
        "negative": message(9, b"\x01", attr(0x21, "job-id", struct.pack(">i", -1))),
        "enum-id": message(9, b"\x01", attr(0x23, "job-id", struct.pack(">i", 1))),
        "unserved": message(0x0012, b"\x01", CHARSET, LANGUAGE),
        "old-version": message(2, b"\x01", CHARSET, version=(9, 9)),
    }
    frame = spark.createDataFrame([(k, bytearray(v)) for k, v in bodies.items()], "name STRING, body BINARY")
    return bodies, frame


def test_named_bodies_in_spark(spark, named):
    bodies, frame = named
    for prefixes in ((4096,), (12, 40), ()):
        for row in decode_messages(frame, prefixes=prefixes).collect():
            want = plain_read(bodies[row.name])
            if row.error is not None:
                got = tuple(v for v in (row.error.reason, row.error.need, row.error.have) if v is not None)
                assert got == want, row.name
            else:
                tokens = with_names([t.asDict() | {"value": bytes(t.value)} for t in row.tokens])
                assert ((row.major, row.minor, row.code, row.request_id), row.header_len, row.groups, tokens) == want, row.name


def test_rejects_and_documents(spark, named):
    bodies, frame = named
    good, bad = split_rejects(decode_messages(frame))
    assert {r.name: (r.error.reason, r.error.need, r.error.have) for r in bad.collect()} == {
        "no-end": ("end-of-data", 1, 0),
        "short-int": ("end-of-data", 4, 3),
        "bad-text": ("bad-utf8", None, None),
    }
    tails = {r.name: bytes(r.document) for r in document_tail(good).collect()}
    assert tails["tail"] == b"%PDF-1.4 fake document"
    assert tails["print"] == b"%PDF-1.4 test"
    assert tails["zero"] == b"\x00tail" and tails["newline"] == b"\x0atail"
    assert tails["ask"] == b""


def test_request_columns(spark, named):
    rows = {r.name: r for r in request_columns(decode_messages(named[1])).collect()}
    assert (rows["print"].job_name, rows["print"].user_name, rows["print"].document_format) == ("Test", "tester", "application/pdf")
    assert rows["duplicate"].job_name == "Untitled"  # the first of the name decides, whatever its type
    assert rows["second-group"].job_name == "Yes"
    assert not rows["no-group"].has_group and rows["no-group"].job_name == "Untitled"
    assert rows["empty-name"].job_name == ""
    assert rows["ask"].wanted is None
    assert rows["wanted"].wanted == ["printer-name", "media", "sides"]
    assert rows["negative"].lookup_job_id == -1
    assert rows["enum-id"].lookup_job_id is None


def test_judged_messages(spark, named):
    frame = named[1].withColumn("avail_bytes", F.lit(None).cast("bigint"))
    rows = {r.name: r for r in judged_messages(frame).collect()}
    assert (rows["print"].http_status, rows["print"].status) == (200, 0)
    assert (rows["no-group"].status, rows["no-group"].reason) == (0x0400, "Missing operation-attributes")
    assert (rows["unserved"].status, rows["old-version"].status) == (0x0501, 0x0400)
    assert (rows["bad-text"].http_status, rows["bad-text"].status, rows["bad-text"].reason) == (400, None, "bad-utf8")
    assert rows["enum-id"].status == 0x0400


def test_typed_values(spark, named):
    good, _ = split_rejects(decode_messages(named[1]))
    exploded = explode_attributes(good.withColumnRenamed("name", "message"), "message")
    rows = typed_values(exploded).collect()
    by = {(r.message, r.name, r.value_pos): r for r in rows}
    assert by["typed", "test-int", 1].int_value == 42 and by["typed", "test-bool", 1].bool_value is True
    assert by["long-int", "n", 1].int_value == 256
    assert by["empty-bool", "b", 1].bool_value is False
    assert by["response", "printer-state", 1].int_value == 3
    assert [by["multi", "document-format-supported", i].str_value for i in (1, 2)] == ["application/pdf", "image/urf"]
    # A collection is not rebuilt: its parts are further values of the attribute.
    assert [by["collection", "media-col", i].tag for i in (1, 2, 3, 4)] == [0x34, 0x4A, 0x21, 0x37]
    assert ("orphan", "", 0) not in by and by["orphan", "kept", 1].str_value == "v"
    assert [bytes(by["raw", n, 1].bin_value) for n in "abc"] == [b"\xff", b"\xfe", b"\xfd"]


def test_reading_one_body_per_file(spark, named, tmp_path):
    for name, body in named[0].items():
        (tmp_path / name).write_bytes(body)
    loaded = decode_messages(read_messages(spark, str(tmp_path)))
    assert loaded.count() == len(named[0])
    assert loaded.where("error is not null").count() == 3


def test_only_prefixes_reach_python_and_once(spark, named):
    plan = request_columns(decode_messages(named[1])).where("op_code = 2").select("job_name")._jdf.queryExecution().executedPlan().toString()
    # Once for each prefix and once for whole bodies, all but the first for the rows that need it.
    assert plan.count("ArrowEvalPython [") == len(PREFIXES) + 1
    assert plan.count("read_headers(CASE WHEN isnull(") == len(PREFIXES) and "Exchange" not in plan


DRIVER_ONLY = """
import sys
sys.path.insert(0, sys.argv[1])
from platenlog.operators.decode import decode_messages
from platenlog.plans.session import build_session
spark = build_session("local[1]", "elsewhere", 1)
print(decode_messages(spark.sql("SELECT X'0101000B0000002A0103' AS body")).first().header_len)
"""


def test_executors_need_no_package(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", DRIVER_ONLY, repo], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120
    )
    assert done.stdout.strip().endswith("10"), done.stderr[-2000:]


def test_headers_are_walked_some_at_a_time(monkeypatch):
    """A batch of any size is walked in parts of so many bodies and bytes, with the results of the whole."""
    bodies = [message(0x000B, b"\x01", attr(0x42, "job-name", b"n" * (k % 40)))[: k % 70] + b"d" * (k % 5000) for k in range(3000)]
    arrays = pa.array(bodies, pa.binary()), pa.array([len(b) for b in bodies], pa.int64())
    whole = walk.read_some(*arrays).to_pylist()
    seen, some = [], walk.read_some

    def noted(part, totals):
        seen.append((len(part), sum(len(b.as_py()) for b in part)))
        return some(part, totals)

    monkeypatch.setattr(walk, "read_some", noted)
    assert walk.read_headers(*arrays).to_pylist() == whole
    assert sum(n for n, _ in seen) == 3000
    assert max(n for n, _ in seen) <= walk.BODIES_AT_ONCE and max(b for _, b in seen) <= walk.WALKED_AT_ONCE
