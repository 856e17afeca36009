"""Attribute tables, listings, display columns, presence and scalar functions."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from platenlog.functions import codes, device, display, naming, numbers
from platenlog.operators import attributes, catalogue, nested, ordering, rollups
from platenlog.operators.ordering import running_sum
from platenlog.operators.presence import presence_intervals
from platenlog.sources.devices import CAPABILITIES, device_attributes, device_snapshots
from platenlog.sources.documents import archive_documents, archive_in_place, list_archive, list_documents, notify_jobs, with_file_names

UTC = dt.timezone.utc


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).collect()[0])


def test_group_values(spark):
    rows = [
        ("m", 1, 1, 0x44, "", "lost"), ("m", 1, 2, 0x44, "a", "1"), ("m", 1, 5, 0x42, "", "2"), ("m", 1, 9, 0x44, "", "3"),
        ("m", 1, 10, 0x44, "a", "4"), ("m", 2, 1, 0x44, "", "lost too"), ("n", 1, 1, 0x44, "b", "5"),
    ]
    tokens = spark.createDataFrame(rows, "msg STRING, grp INT, pos INT, tag INT, name STRING, value STRING")
    for bits in (0, 2, 20):
        got = {(r.msg, r.grp, r.attr_pos): (r.name, [(v.tag, v.value) for v in r["values"]]) for r in attributes.group_values(tokens, bits).collect()}
        assert got == {
            ("m", 1, 1): ("a", [(0x44, "1"), (0x42, "2"), (0x44, "3")]),
            ("m", 1, 2): ("a", [(0x44, "4")]),
            ("n", 1, 1): ("b", [(0x44, "5")]),
        }


ATTRIBUTES = "msg STRING, group_pos INT, delimiter INT, attr_pos INT, name STRING, value_pos INT, tag INT, value STRING"


def test_first_value_and_group(spark):
    rows = [
        ("a", 2, 1, 1, "job-name", 1, 0x44, "word"), ("a", 2, 1, 2, "job-name", 1, 0x42, "later"),
        ("b", 3, 1, 4, "job-name", 2, 0x42, "second"), ("b", 3, 1, 4, "job-name", 1, 0x42, "first"), ("b", 5, 1, 1, "job-name", 1, 0x42, "other group"),
        ("b", 1, 4, 1, "job-name", 1, 0x42, "not an operation group"), ("c", 1, 1, 1, "other", 1, 0x42, "x"), ("d", 1, 2, 1, "job-name", 1, 0x42, "x"),
    ]
    mine = attributes.first_group(spark.createDataFrame(rows, ATTRIBUTES))
    assert {(r.msg, r.group_pos) for r in mine.collect()} == {("a", 2), ("b", 3), ("c", 1)}
    got = {r.msg: r.value for r in attributes.first_value(mine, "job-name", [codes.TEXT, codes.NAME], "Untitled").collect()}
    assert got == {"a": "Untitled", "b": "first", "c": "Untitled"}


def test_requested_attributes(spark):
    n = "requested-attributes"
    rows = [
        ("a", 1, 1, 1, n, 1, 0x44, "x"), ("a", 1, 1, 1, n, 2, 0x42, "not a keyword"), ("a", 1, 1, 3, n, 1, 0x44, "y"),
        ("b", 1, 1, 1, "other", 1, 0x44, "x"), ("c", 1, 1, 1, n, 1, 0x42, "x"), ("a", 2, 1, 1, n, 1, 0x44, "second group"),
    ]
    got = {r.msg: r.wanted and sorted(r.wanted) for r in attributes.requested_attributes(spark.createDataFrame(rows, ATTRIBUTES)).collect()}
    assert got == {"a": ["x", "y"], "b": None, "c": None}


def device_rows(spark):
    return spark.createDataFrame(
        [(1, "ipp://10.0.0.1:6310/ipp/print", "One", "M", "I", "", "u-1", 77), (2, "ipp://h:1/ipp/print", "Two", "M", "I", "", "u-2", 78)],
        "device_id BIGINT, uri STRING, name STRING, model STRING, info STRING, location STRING, uuid STRING, up_time BIGINT",
    )


def test_attribute_query(spark):
    assert len(CAPABILITIES) == 54 and len({c[0] for c in CAPABILITIES}) == 54
    asked = spark.createDataFrame(
        [(1, 1, None), (2, 1, ["all", "x"]), (3, 2, ["printer-name", "no-such"]), (4, 2, []), (5, 1, ["no-such"]), (6, 9, None), (7, 2, ["job-template"])],
        "seq BIGINT, device_id BIGINT, wanted ARRAY<STRING>",
    )
    got = attributes.attribute_query(asked, device_snapshots(device_rows(spark))).collect()
    names = {}
    for r in got:
        names.setdefault(r.seq, set()).add(r.name)
    assert {k: len(v) for k, v in names.items()} == {1: 54, 2: 54, 3: 1, 4: 54}
    assert [(r.value, r.tag) for r in got if r.seq == 3] == [("Two", 0x42)]
    assert [r.value for r in got if r.seq == 1 and r.name == "printer-more-info"] == ["http://10.0.0.1:6310/"]
    values = [(r.value_pos, r.value) for r in got if r.seq == 1 and r.name == "ipp-versions-supported"]
    assert sorted(values) == [(1, "1.0"), (2, "1.1"), (3, "2.0")]


def test_device_attributes_from_store(spark, tmp_path):
    device_snapshots(device_rows(spark)).write.parquet(str(tmp_path / "d"))
    got = device_attributes(spark, str(tmp_path / "d"))
    assert got.count() == 2 * sum(len(values) for _, _, values in CAPABILITIES)
    assert "attributes" in plan(got) and got.where("name = 'printer-state' and value = '3'").count() == 2


def listing(spark, sizes):
    rows = [(s, f"{s}-{i:03d}", 10 * i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 2)) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "session_id STRING, file_name STRING, size_bytes BIGINT, modified TIMESTAMP")


def test_pages(spark):
    files = listing(spark, {"a": 12, "b": 5, "c": 6})
    assert {r.session_id: (r.files, r.pages) for r in catalogue.archive_counts(files).collect()} == {"a": (12, 3), "b": (5, 1), "c": (6, 2)}
    order = ["a-010", "a-011", "a-008", "a-009", "a-006", "a-007", "a-004", "a-005", "a-002", "a-003", "a-000", "a-001"]
    numbered = {r.file_name: (r.position, r.page) for r in catalogue.page_numbers(files).collect() if r.session_id == "a"}
    assert numbered == {n: (i, i // 5) for i, n in enumerate(order)}
    for k, want in ((0, {"a": order[:5]}), (1, {"a": order[5:10], "c": ["c-001"]}), (2, {"a": order[10:]}), (7, {"a": order[:5]})):
        shown = {}
        for r in catalogue.page(files, k).orderBy("session_id", "position").collect():
            shown.setdefault(r.session_id, []).append(r.file_name)
        assert shown["a"] == want["a"] and len(shown["b"]) == 5
        assert shown["c"] == want.get("c", ["c-004", "c-005", "c-002", "c-003", "c-000"])
    deep = catalogue.page(files, 500).select("file_name").collect()
    assert len(deep) == 15
    assert [r.file_name for r in catalogue.newest_first(files).limit(2).collect()] == ["a-010", "a-011"]
    # Any page has the same columns, and none takes a task per session.
    assert catalogue.page(files, 0).columns == catalogue.page(files, 500).columns
    shown = re.sub(r"#\d+L?", "", plan(catalogue.page(files, 0)))
    assert set(re.findall(r"windowspecdefinition\(session_id, (\w+)", shown)) <= {"_part"}


def test_catalogue_from_names(spark):
    names = ["1704067200_12_My_file.v2.pdf", "1_2_.pdf", "notes.pdf", "1704067200_x_a.pdf", "1_2_a.ps", "18446744073709551615_1_a.pdf", "5_6_1_2_b.pdf.pdf"]
    files = spark.createDataFrame([(n, 1) for n in names], "file_name STRING, size_bytes BIGINT")
    got = {r.file_name: (r.time_created, r.job_id, r.safe_name) for r in catalogue.catalogue_from_names(files).collect()}
    assert got == {
        names[0]: (1704067200, 12, "My_file.v2"), names[1]: (1, 2, ""), names[5]: (None, 1, "a"), names[6]: (5, 6, "1_2_b.pdf"),
    }


def test_names(spark):
    cases = {
        "Report 2024/05.pdf": "Report_2024_05.pdf", "é中ⅷ٣-_.": "é中ⅷ٣-_.", "áb": "a_b", "😀x": "_x", "": "", "a\nb\tc": "a_b_c", "№½": "_½",
    }
    got = {r.n: r.s for r in spark.createDataFrame([(n,) for n in cases], "n STRING").select("n", naming.safe_name("n").alias("s")).collect()}
    assert got == cases
    assert one(spark, F.length(naming.safe_name(F.lit("中" * 80)))) == (64,)
    assert one(spark, F.length(naming.safe_name(F.lit("😀" * 80)))) == (64,)
    assert one(spark, naming.host_port(F.lit("ipp://ipp://h:1/x/y")), naming.host_port(F.lit("h")), naming.host_port(F.lit("http://h/"))) == ("h:1", "h", "http:")
    assert one(spark, naming.host_slug(F.lit("My Print Er")), naming.printer_uri(F.lit("1.2.3.4"), F.lit(631))) == ("my-print-er.local.", "ipp://1.2.3.4:631/ipp/print")


def test_numbers(spark):
    size = lambda n: numbers.human_size(F.lit(n))
    assert one(spark, *[size(n) for n in (0, 1023, 1024, 1048575, 1048576, 5 * 2**40)]) == ("0 B", "1023 B", "1 KB", "1023 KB", "1 MB", "5242880 MB")
    assert one(spark, *[numbers.k_octets(F.lit(n)) for n in (0, 1023, 2047, 2048)]) == (1, 1, 1, 2)
    assert one(spark, *[numbers.pages(F.lit(n)) for n in (0, 1, 5, 6)]) == (1, 1, 1, 2)
    assert one(spark, *[numbers.wrap_i32(F.lit(n)) for n in (2**31 - 1, 2**31, 2**32, -1, 2**63 - 1)]) == (2**31 - 1, -(2**31), 0, -1, -1)
    raw = lambda h: F.unhex(F.lit(h))
    assert one(spark, numbers.be_int(raw("FFFFFFFE")), numbers.be_int(raw("7FFFFFFF")), numbers.be_uint(raw("FFFF")), numbers.be_int(raw("80"), 1)) == (-2, 2**31 - 1, 65535, -128)
    assert one(spark, numbers.code_hex(F.lit(0x40F)), numbers.code_hex(F.lit(10))) == ("unknown-0x040f", "unknown-0x000a")


def test_display(spark):
    names = {"a.PDF": ("pdf", "application/pdf", "\U0001F4C4"), "pdf": ("", "*/*", "\U0001F4C4"), "b.tar.ps": ("ps", "application/postscript", "\U0001F5A8"), "c.": ("", "*/*", "\U0001F4C1")}
    frame = spark.createDataFrame([(n, 1, dt.datetime(2024, 3, 4, 5, 6, tzinfo=UTC)) for n in names], "file_name STRING, size_bytes BIGINT, modified TIMESTAMP")
    got = {r.file_name: (r.extension, r.mime, r.kind) for r in catalogue.display_columns(frame).collect()}
    assert got == names
    assert catalogue.display_columns(frame).first().stamp == "03/04 05:06"
    assert one(spark, display.short_stamp(F.lit(0))) == ("01/01 00:00",)


def test_device_values(spark):
    fields = ["year", "month", "day", "hour", "minutes", "seconds", "deci_seconds", "direction", "offset_hours", "offset_minutes"]

    def instant(*values):
        struct = F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, values)])
        return F.unix_micros(device.device_time(struct))

    noon = int(dt.datetime(2024, 2, 29, 12, 30, 15, tzinfo=UTC).timestamp() * 1e6)
    assert one(
        spark,
        instant(2024, 2, 29, 12, 30, 15, 5, 43, 0, 0),
        instant(2024, 2, 29, 12, 30, 15, 0, 43, 5, 30),
        instant(2024, 2, 29, 12, 30, 15, 0, 45, 8, 0),
        instant(2023, 2, 29, 12, 30, 15, 0, 43, 0, 0),
        instant(2024, 2, 29, 12, 30, 15, 10, 43, 0, 0),
        instant(2024, 2, 29, 12, 30, 15, 0, 42, 0, 0),
        instant(2024, 2, 29, 25, 30, 15, 0, 43, 0, 0),
        instant(2024, 2, 29, 12, 30, 15, 0, 43, 200, 0),
    ) == (noon + 500000, noon - 19800 * 10**6, noon + 28800 * 10**6, None, None, None, None, None)
    record = one(spark, device.txt_record(F.lit("1.2.3.4"), F.lit(9), F.lit("M"), F.lit("U"), F.lit("N")))[0]
    assert len(record) == 14 and record["adminurl"] == "http://1.2.3.4:9/" and record["rp"] == "ipp/print"
    dims = one(spark, device.media_dims(F.struct(F.lit(21590).alias("x_dimension"), F.lit(27940).alias("y_dimension"))))[0]
    assert tuple(dims) == (215.9, 279.4)


def test_code_names(spark):
    frame = spark.createDataFrame([(0x0406,), (0x040A,), (0,), (None,), (0x7777,)], "status INT")
    got = {r.status: (r.status_name, r.ok) for r in rollups.status_ok(frame).collect()}
    assert got == {
        0x0406: ("unknown-0x0406", False), 0x040A: ("client-error-document-format-not-supported", False), 0: ("successful-ok", True),
        None: (None, None), 0x7777: ("unknown-0x7777", False),
    }
    assert (len(codes.OPERATIONS), len(codes.STATUSES), len(codes.DELIMITERS), len(codes.VALUE_TAGS)) == (15, 28, 5, 23)


def plain_spans(heard, life):
    spans = {}
    for d, t in sorted(heard):
        mine = spans.setdefault(d, [])
        if mine and t < mine[-1][1] + life:
            mine[-1][1] = t
            mine[-1][2] += 1
        else:
            mine.append([t, t, 1])
    return sorted((d, s, e + life, n) for d, mine in spans.items() for s, e, n in mine)


def test_presence(spark):
    rng = random.Random(6)
    second = 10**6
    heard = [("exact", 0), ("exact", 120 * second), ("near", 0), ("near", 120 * second - 1), ("old", -5 * second), ("old", -1), ("old", 119 * second)]
    heard += [("hot" if rng.random() < 0.5 else f"d{rng.randrange(9)}", rng.randrange(40000) * second) for _ in range(3000)]
    frame = spark.createDataFrame(heard, "device_id STRING, us BIGINT").select("device_id", F.timestamp_micros("us").alias("ts"))
    got = presence_intervals(frame).select("device_id", F.unix_micros("online_from"), F.unix_micros("offline_at"), "announcements")
    want = plain_spans(heard, 120 * second)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(d == "exact" for d, *_ in want) == 2 and sum(d == "near" for d, *_ in want) == 1


def test_documents(spark, tmp_path):
    docs = spark.createDataFrame(
        [("s", f"{i}_1_a.pdf", 3, dt.datetime(2024, 1, 1 + i, 9), bytearray(b"abc")) for i in range(3)],
        "session_id STRING, file_name STRING, size_bytes BIGINT, modified TIMESTAMP, payload BINARY",
    )
    archive_documents(docs, str(tmp_path / "a"))
    kept = list_archive(spark, str(tmp_path / "a"))
    assert kept.count() == 3 and "payload" not in plan(kept)
    assert spark.read.parquet(str(tmp_path / "a")).where("day = '2024-01-02'").count() == 1
    (tmp_path / "f" / "sub").mkdir(parents=True)
    (tmp_path / "f" / "x.pdf").write_bytes(b"12345")
    (tmp_path / "f" / "sub" / "y.pdf").write_bytes(b"1")
    listed = list_documents(spark, str(tmp_path / "f"))
    assert [(r.file_name, r.size_bytes) for r in listed.collect()] == [("x.pdf", 5)]
    assert "content" not in plan(listed)
    told = []
    notify_jobs(docs.withColumn("job_id", F.lit(1)), "/d/", lambda df, i: told.append((i, sorted(r.file_path for r in df.collect()))))
    assert told == [(0, ["/d/0_1_a.pdf", "/d/1_1_a.pdf", "/d/2_1_a.pdf"])]


def test_archive_in_place(spark, tmp_path):
    rows = [
        ("s", 1, dt.datetime(2024, 1, 1, 9, 0, 0, 500), 2, 0, 3, bytearray(b"abc")), ("s", 2, dt.datetime(2024, 1, 2), 2, 0x0500, 3, bytearray(b"no!")),
        ("s", 3, dt.datetime(2024, 1, 2), 4, 0, 3, bytearray(b"no!")), ("s", 4, dt.datetime(2024, 1, 2), 2, 0, 2, bytearray(b"de")),
    ]
    judged = spark.createDataFrame(rows, "session_id STRING, seq BIGINT, arrived_at TIMESTAMP, op_code INT, status INT, doc_bytes BIGINT, payload BINARY")
    archive_in_place(judged, str(tmp_path / "a"))
    jobs = spark.createDataFrame([("s", 1, 1, "one"), ("s", 3, 4, "two")], "session_id STRING, job_id BIGINT, created_seq BIGINT, file_name STRING")
    named = with_file_names(spark.read.parquet(str(tmp_path / "a")), jobs)
    assert {r.file_name: (r.job_id, bytes(r.payload), r.size_bytes, str(r.day), r.modified.microsecond) for r in named.collect()} == {
        "one": (1, b"abc", 3, "2024-01-01", 0), "two": (3, b"de", 2, "2024-01-02", 0),
    }


def test_numbering_with_sparse_order(spark):
    """Ids made from the time: a block for each row, and still no window over a whole session."""
    rows = [("hot", (k * 7919 % 5000) << 40) for k in range(3000)] + [("s", k << 22) for k in range(50)] + [("t", -(k << 30)) for k in range(50)]
    log = spark.createDataFrame(rows, "session_id STRING, seq BIGINT")
    numbered = running_sum(log, ["session_id"], "seq", F.lit(1), "n")
    place: dict = {}
    for session, seq in sorted(set(rows)):
        place[session, seq] = sum(1 for s, q in rows if s == session and q <= seq)
    got = numbered.collect()
    assert len(got) == len(rows) and all(r.n == place[r.session_id, r.seq] for r in got)
    text = numbered._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"windowspecdefinition\(session_id#\d+, (\w+)", text)
    # Beside the rows' own blocks and the groups of blocks, only the last level, of 2**20 groups at most, is by session alone.
    assert "_group" in windows and [w for w in windows if w not in ("_block", "_group")] == []


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """Numbered, folded and nested values of a larger table are dealt to more tasks than the session names, with the same rows."""
    monkeypatch.setattr(ordering, "TASK_ROWS", 50)
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    draw = random.Random(9)
    rows = [(f"m{k % 7}", k % 3, k * 3, 0x44, draw.choice(["", "a", "b"]), str(k)) for k in range(50 * own + 200)]
    many = spark.createDataFrame(rows, "msg string, grp int, pos int, tag int, name string, value string")
    tasks = ordering.tasks_for(many)
    assert tasks == own + 4 and ordering.tasks_for(many.limit(50)) is None and ordering.tasks_for(many.limit(50), 60 * own) == 60 * own
    for block_bits in (4, 20):
        assert f", {tasks})" in plan(attributes.value_islands(many, block_bits))
        got = [tuple(r) for r in attributes.value_islands(many, block_bits).select("msg", "grp", "pos", "attr_pos").collect()]
        so_far, want = {}, []
        for msg, grp, pos, _, name, _ in rows:
            so_far[msg, grp] = so_far.get((msg, grp), 0) + (name != "")
            want.append((msg, grp, pos, so_far[msg, grp]))
        assert sorted(got) == sorted(want)
        folded = attributes.group_values(many, block_bits)
        assert plan(folded).count(f", {tasks})") >= 3
        assert folded.select(F.sum(F.size("values"))).first()[0] == sum(1 for w in want if w[3])


def test_nested_tasks(spark):
    values = spark.createDataFrame([("m", 1, 1, 1, "a", k, 0x21, b"1") for k in range(1, 4)], "msg string, group_pos int, delimiter int, attr_pos int, name string, value_pos int, tag int, value binary")
    dealt = nested.nested_values(values, "msg", tasks=77)
    assert ", 77)" in plan(dealt) and plan(dealt).count("Exchange") == 1
    assert [r.item for r in dealt.orderBy("place").collect()] == [1, 2, 3]
