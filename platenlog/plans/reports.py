"""The registered queries: every operator run over the driver tables.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame; nothing here is
part of an operator.
"""

from __future__ import annotations

from functools import partial

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platenlog.functions import codes, device, display, naming, numbers
from platenlog.operators import answers, attributes, catalogue, decode, nested, presence, rollups
from platenlog.operators.admission import admission, dispatch, gate
from platenlog.operators.jobs import assign_job_ids, job_lookup, print_answers, register_jobs
from platenlog.operators.ordering import tasks_for
from platenlog.plans.capture import attribute, capture, collection, fixed, header, text, text_places
from platenlog.plans.flow import registry_from_requests, requests_from_capture
from platenlog.plans.requests import key_range, request_log, table
from platenlog.plans.session import STREAM_SETTINGS, work_path
from platenlog.sources import pages
from platenlog.sources.devices import device_attributes, device_snapshots, explode_devices
from platenlog.sources.documents import archive_documents, archive_in_place, list_archive, notice, notify_jobs, with_file_names
from platenlog.sources.messages import read_message_stream, read_messages
from platenlog.sources.notices import committed_notices, write_notices
from platenlog.streaming import intake, registry
from platenlog.streaming.admission import judged_messages, stream_admission
from platenlog.streaming.presence import open_spans, stream_presence, stream_presence_changes

PRINTER_URI = "ipp://192.0.2.1:6310/ipp/print"
ARRIVALS = 4
FILES_A_BATCH = 3
# Of media_messages, about.
TOKENS_A_MESSAGE = 48


# --- inputs derived from the tables --------------------------------------------------


def slim_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log as a written table: texts are read once, for their length, however often it is used."""
    path = work_path(spark, "requests")
    request_log(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def jobs_in(log: DataFrame) -> DataFrame:
    return register_jobs(assign_job_ids(log))


def jobs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs_in(slim_log(spark, sf_dir))


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows of the registry's files."""
    return jobs_of(spark, sf_dir).select(
        "session_id", "file_name", "size_bytes", F.timestamp_seconds("time_created").alias("modified")
    )


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the tokens of one message per order."""
    line = F.col("l_linenumber").cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("msg"),
        (1 + F.col("l_partkey") % 2).alias("grp"),
        ((F.col("l_partkey") * 1000000 + F.col("l_suppkey")) * 10 + line).alias("pos"),
        F.when(line % 3 == 0, "").otherwise(F.concat(F.lit("attr-"), "l_returnflag")).alias("name"),
        (F.lit(65) + F.col("l_suppkey") % 3).cast("int").alias("tag"),
        F.concat("l_linestatus", line.cast("string")).alias("value"),
    )


def attribute_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the attributes of one message per order."""
    line = F.col("l_linenumber").cast("bigint")
    group = 1 + line % 3
    kind, shape = F.col("l_partkey") % 4, F.col("l_suppkey") % 4
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("msg"),
        group.alias("group_pos"),
        F.when((F.col("l_orderkey") + group) % 2 == 0, 1).otherwise(4).alias("delimiter"),
        ((F.col("l_partkey") * 1000000 + F.col("l_suppkey")) * 10 + line).alias("attr_pos"),
        F.lit(1).alias("value_pos"),
        F.when(kind == 0, "requested-attributes")
        .when(kind == 1, "job-name")
        .when(kind == 2, "document-format")
        .otherwise("job-id")
        .alias("name"),
        F.when(shape == 0, 0x44).when(shape == 1, 0x42).when(shape == 2, 0x49).otherwise(0x21).alias("tag"),
        F.concat("l_returnflag", line.cast("string")).alias("value"),
    )


def http_columns(key: str) -> dict[str, Column]:
    """What came with a request, some of which breaks a rule."""
    k = F.col(key)
    return {
        "method": F.when(k % 9 == 0, "GET").otherwise("POST"),
        "path": F.when(k % 8 == 0, "/ipp/other").when(k % 8 == 1, "/").otherwise("/ipp/print"),
        "content_type": F.when(k % 7 == 0, None)
        .when(k % 7 == 1, "application/ipp; charset=utf-8")
        .when(k % 7 == 2, "text/html")
        .when(k % 7 == 3, "Application/ipp")
        .otherwise("application/ipp"),
    }


def http_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as HTTP requests."""
    k = F.col("doc_id")
    size = F.octet_length("text")
    return table(spark, sf_dir, "documents").select(
        k.alias("seq"),
        *[column.alias(name) for name, column in http_columns("doc_id").items()],
        F.when(k % 10 == 0, codes.MAX_BODY_BYTES + 1).when(k % 10 == 1, codes.MAX_BODY_BYTES).otherwise(size).cast("bigint").alias("body_bytes"),
    )


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured bodies of which most are cut short, anywhere in their header, or garbled in a name or a text."""
    log = request_log(spark, sf_dir, payload=True)
    seq = F.col("seq")
    names, texts = text_places(log)
    bodies = log.select("*", F.octet_length(header(log)).alias("_length"), names.alias("_names"), texts.alias("_texts"))

    def garbled(places: str):
        """One byte of one of the places becomes FF, which no text has."""
        place = F.element_at(places, (1 + seq % F.size(places)).cast("int"))
        at = (place["start"] + seq % place["length"]).cast("int")
        return F.concat(F.substr("body", F.lit(1), at), F.unhex(F.lit("FF")), F.substr("body", at + 2))

    body = (
        F.when(seq % 9 == 0, F.col("body"))
        .when(seq % 9 == 7, garbled("_names"))
        .when(seq % 9 == 8, garbled("_texts"))
        .otherwise(F.substr("body", F.lit(1), (seq * 7919 % F.col("_length")).cast("int")))
    )
    whole = capture(bodies, "_length", "_names", "_texts")
    return whole.withColumn("body", body).drop("_length", "_names", "_texts")


def devices_of(spark: SparkSession, sf_dir: str, name: str, key: str, label: str) -> DataFrame:
    """Customers or suppliers as devices."""
    k = F.col(key)
    return table(spark, sf_dir, name).select(
        k.alias("device_id"),
        naming.printer_uri(F.concat(F.lit("10.0.0."), (k % 256).cast("string")), 6310 + k % 10).alias("uri"),
        F.col(label).alias("name"),
        F.lit("Virtual PDF Printer").alias("model"),
        F.concat(F.lit("Printer of "), F.col(label)).alias("info"),
        F.lit("").alias("location"),
        F.format_string("00000000-0000-0000-0000-%012d", k).alias("uuid"),
        (F.lit(1704067200) + k).alias("up_time"),
    )


def asking_rows(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The log's attribute requests, each with a device and a list of names, and ``more`` of the log's columns."""
    k = F.col("seq")
    wanted = (
        F.when(k % 4 == 1, F.array(F.lit("all")))
        .when(k % 4 == 2, F.array(F.lit("printer-name"), F.lit("printer-state"), F.lit("no-such-name")))
        .when(k % 4 == 3, F.array(F.lit("media-col-database"), F.lit("printer-more-info")))
    )
    return (
        request_log(spark, sf_dir)
        .where(F.col("op_code") == codes.GET_PRINTER_ATTRIBUTES)
        .select("seq", (k % key_range(spark, sf_dir)).alias("device_id"), wanted.alias("wanted"), *more)
    )


def arrivals(spark: SparkSession, rows: DataFrame, order: str = "seq") -> str:
    """Lay rows down as a few files, in order of arrival, for a stream to pick up."""
    whole, path = work_path(spark, "staged"), work_path(spark, "arrivals")
    rows.write.parquet(whole)
    staged = spark.read.parquet(whole)
    top = staged.agg((F.max(order) + 1).alias("n")).first()["n"]
    for i in range(ARRIVALS):
        due = (F.col(order) >= top * i // ARRIVALS) & (F.col(order) < top * (i + 1) // ARRIVALS)
        # Each arrival is one stretch of the log, in as many files as a batch takes.
        staged.where(due).repartition(FILES_A_BATCH).write.mode("append").parquet(path)
    return path


def arriving_log(spark: SparkSession, sf_dir: str, payload: bool = False) -> DataFrame:
    log = request_log(spark, sf_dir, payload)
    return read_message_stream(spark, arrivals(spark, log), log.schema, max_files=FILES_A_BATCH)


# --- requests ------------------------------------------------------------------------


def gate_status(spark, sf_dir):
    return gate(http_rows(spark, sf_dir)).select("seq", "http_status")


def admission_report(spark, sf_dir):
    return admission(request_log(spark, sf_dir)).select("seq", "session_id", "op_code", "status", "reason")


def dispatch_report(spark, sf_dir):
    return dispatch(request_log(spark, sf_dir)).select("seq", "op_code", "supported", "dispatch_status")


def request_rollup(spark, sf_dir):
    return rollups.request_rollup(admission(request_log(spark, sf_dir)))


def code_names(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 90).cast("int").alias("tag"),
        (F.col("o_orderkey") % 7).cast("int").alias("delimiter"),
        (F.col("o_custkey") % 11).cast("int").alias("state"),
    )
    counted = orders.groupBy("tag", "delimiter", "state").agg(F.count(F.lit(1)).alias("n"))
    named = rollups.with_code_names(counted, "tag", codes.VALUE_TAGS, "tag_name")
    named = rollups.with_code_names(named, "delimiter", codes.DELIMITERS, "delimiter_name")
    return rollups.with_code_names(named, "state", codes.JOB_STATES, "state_name")


def job_registry(spark, sf_dir):
    return jobs_of(spark, sf_dir).withColumn("k_octets", numbers.k_octets("size_bytes"))


def id_gaps(spark, sf_dir):
    return (
        jobs_of(spark, sf_dir)
        .groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("jobs"), F.max("job_id").alias("last_job_id"))
        .withColumn("missing", F.col("last_job_id") - F.col("jobs"))
    )


def lookup_report(spark, sf_dir):
    log = slim_log(spark, sf_dir)
    return job_lookup(log, jobs_in(log), F.lit(PRINTER_URI))


def status_report(spark, sf_dir):
    return rollups.status_ok(lookup_report(spark, sf_dir).select("seq", "status"))


def print_report(spark, sf_dir):
    return print_answers(slim_log(spark, sf_dir), F.lit(PRINTER_URI))


# --- attributes ----------------------------------------------------------------------


def device_report(spark, sf_dir):
    path = work_path(spark, "devices")
    device_snapshots(devices_of(spark, sf_dir, "supplier", "s_suppkey", "s_name")).write.parquet(path)
    return device_attributes(spark, path)


def attribute_query(spark, sf_dir):
    snapshots = device_snapshots(devices_of(spark, sf_dir, "customer", "c_custkey", "c_name"))
    return attributes.attribute_query(asking_rows(spark, sf_dir), snapshots)


def asking_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests as captured bodies, with the list in the header, and a list that is no keyword before it."""
    wanted = F.coalesce("wanted", F.array().cast("array<string>"))
    words = F.transform(
        wanted,
        lambda w, k: F.when(k == 0, attribute(codes.KEYWORD, "requested-attributes", text(w))).otherwise(
            attribute(codes.KEYWORD, "", text(w))
        ),
    )
    listed = F.aggregate(words, F.unhex(F.lit("")), lambda before, word: F.concat(before, word))
    other = attribute(codes.NAME, "requested-attributes", text(F.lit("printer-uuid")))
    head = F.concat(F.unhex(F.lit("0200000B")), fixed(F.col("seq"), 4), F.unhex(F.lit("01")))
    body = F.concat(head, other, listed, F.unhex(F.lit("03")))
    return asking_rows(spark, sf_dir).select("seq", "device_id", body.alias("body"))


def attribute_answers(spark, sf_dir):
    """Decoded requests, answered from the long table of device attributes."""
    path = work_path(spark, "asked")
    # Decoded once; the answers read the requests twice.
    decoded = decode.request_columns(decode.decode_messages(asking_bodies(spark, sf_dir)))
    decoded.select("seq", "device_id", "wanted").write.parquet(path)
    asked = spark.read.parquet(path)
    held = explode_devices(device_snapshots(devices_of(spark, sf_dir, "customer", "c_custkey", "c_name")))
    return answers.attribute_answers(asked, held)


def dated_answers(spark, sf_dir):
    """Requests answered from what their device was at the time: three dated snapshots a device, none before the first."""
    k = F.col("device_id")
    days = F.explode(F.array(*[F.lit(n) for n in range(3)]))
    taken = F.timestamp_seconds(F.lit(1704067200) + (k % 7) * 7200 + F.col("n") * 36000)

    def dated(rows):
        return rows.withColumn("n", days).withColumns({"taken_at": taken, "name": F.concat("name", F.lit(" v"), F.col("n").cast("string"))})

    devices = devices_of(spark, sf_dir, "customer", "c_custkey", "c_name")
    asked = asking_rows(spark, sf_dir, "arrived_at")
    stored = work_path(spark, "known")
    answers.as_of(asked, dated(devices).select("device_id", "taken_at")).write.parquet(stored)
    known = spark.read.parquet(stored)
    # Only snapshots that answer something are laid out as attributes: no more than there are requests.
    due = known.select("device_id", "taken_at").distinct()
    meant = dated(devices.join(due, "device_id", "left_semi")).join(due, ["device_id", "taken_at"], "left_semi")
    keyed = meant.withColumn("device_id", F.struct("device_id", "taken_at"))
    held = explode_devices(device_snapshots(keyed)).select("device_id.*", "pos", "name", "value_pos", "tag", "value")
    told = answers.attribute_answers(known, held, ("device_id", "taken_at"))
    return told.select("seq", "device_id", F.unix_seconds("taken_at").alias("taken_s"), "pos", "name", "value_pos", "tag", "value")


def requested_attributes(spark, sf_dir):
    wanted = attributes.requested_attributes(attribute_rows(spark, sf_dir))
    return wanted.select("msg", F.array_join(F.array_sort("wanted"), ",").alias("wanted"))


def first_value(spark, sf_dir):
    return attributes.first_value(attribute_rows(spark, sf_dir), "job-name", [codes.TEXT, codes.NAME], "Untitled")


def first_group(spark, sf_dir):
    return (
        attributes.first_group(attribute_rows(spark, sf_dir))
        .groupBy("msg", "group_pos")
        .agg(F.count(F.lit(1)).alias("attributes"))
    )


def value_islands(spark, sf_dir):
    return attributes.value_islands(token_rows(spark, sf_dir)).select("msg", "grp", "pos", "attr_pos")


def grouped_values(spark, sf_dir):
    shown = F.transform("values", lambda v: F.concat(v["tag"].cast("string"), F.lit(":"), v["value"]))
    return attributes.group_values(token_rows(spark, sf_dir)).select(
        "msg", "grp", "attr_pos", "name", F.array_join(shown, ",").alias("values")
    )


def typed_values(spark, sf_dir):
    c, kind, date = F.col("o_custkey"), F.col("o_orderkey") % 8, F.col("o_orderdate")
    u32 = lambda n: fixed(n.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)), 4)
    stamp = F.concat(
        fixed(F.year(date), 2),
        fixed(F.when(c % 50 == 0, 13).otherwise(F.month(date)), 1),
        fixed(F.dayofmonth(date), 1),
        fixed(c % 24, 1),
        fixed(c % 60, 1),
        fixed(c % 59, 1),
        fixed(c % 10, 1),
        fixed(F.when(c % 2 == 0, 43).otherwise(45), 1),
        fixed(c % 14, 1),
        fixed(F.when(c % 3 == 0, 30).otherwise(0), 1),
    )
    tokens = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(kind == 0, codes.INTEGER)
        .when(kind == 1, codes.ENUM)
        .when(kind == 2, codes.BOOLEAN)
        .when(kind == 3, codes.TEXT)
        .when(kind == 4, codes.DATE_TIME)
        .when(kind == 5, codes.RESOLUTION)
        .when(kind == 6, codes.RANGE_OF_INTEGER)
        .otherwise(codes.OCTET_STRING)
        .alias("tag"),
        F.when(kind == 0, u32(-c))
        .when(kind == 1, u32(c))
        .when(kind == 2, F.when(c % 3 == 0, F.unhex(F.lit(""))).otherwise(fixed(c % 2, 1)))
        .when(kind == 3, text(F.col("o_orderpriority")))
        .when(kind == 4, stamp)
        .when(kind == 5, F.concat(u32(300 + c % 100), u32(600 + c % 100), fixed(F.lit(3), 1)))
        .when(kind == 6, F.concat(u32(-c - 1), u32(c)))
        .otherwise(u32(c))
        .alias("value"),
    )
    return attributes.typed_values(tokens).select(
        "o_orderkey",
        "tag",
        "int_value",
        "bool_value",
        "str_value",
        F.hex("bin_value").alias("bin_hex"),
        "resolution.cross_feed",
        "resolution.feed",
        "resolution.units",
        "int_range.lower",
        "int_range.upper",
        F.unix_micros("instant").alias("instant_us"),
    )


# --- listings ------------------------------------------------------------------------


def listing_page(spark, sf_dir, k):
    return catalogue.page(files_of(spark, sf_dir), k).select(
        "session_id", "position", "page", "file_name", "size_bytes", "files", "pages"
    )


def listing_by_day(spark: SparkSession, sf_dir: str) -> str:
    path = work_path(spark, "listing")
    pages.write_listing(files_of(spark, sf_dir), path)
    return path


def indexed_page(spark, sf_dir, k):
    return pages.read_page(spark, listing_by_day(spark, sf_dir), k).select(
        "session_id", "position", "page", "file_name", "size_bytes", "files", "pages"
    )


def newest_first(spark, sf_dir):
    return catalogue.newest_first(files_of(spark, sf_dir)).select("session_id", "file_name", "size_bytes")


def page_numbers(spark, sf_dir):
    return catalogue.page_numbers(files_of(spark, sf_dir)).select("session_id", "file_name", "position", "page")


def archive_counts(spark, sf_dir):
    return catalogue.archive_counts(files_of(spark, sf_dir))


def catalogue_from_names(spark, sf_dir):
    return catalogue.catalogue_from_names(files_of(spark, sf_dir))


def display_columns(spark, sf_dir):
    k, size = F.col("doc_id"), F.col("n_chars")
    ending = F.when(k % 5 == 0, ".PDF").when(k % 5 == 1, ".ps").when(k % 5 == 2, "").when(k % 5 == 3, ".tar.gz").otherwise(".pdf")
    times = F.when(k % 3 == 0, 1).when(k % 3 == 1, 1024).otherwise(1048576)
    d = table(spark, sf_dir, "documents").select(
        k, F.concat(F.lit("Doc_"), k.cast("string"), ending).alias("file_name"), (size * times).alias("size_bytes")
    )
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("modified"))
    return catalogue.display_columns(d.join(e, k == F.col("event_id")))


# --- functions -----------------------------------------------------------------------


def name_functions(spark, sf_dir):
    k = F.col("c_custkey")
    host = F.concat(F.lit("192.168."), (k % 256).cast("string"), F.lit(".7"))
    uri = naming.printer_uri(host, 6000 + k % 1000)
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        naming.safe_name(F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit(" №é中"))).alias("safe_name"),
        uri.alias("printer_uri"),
        naming.job_uri(uri, k).alias("job_uri"),
        naming.host_port(F.concat(F.when(k % 2 == 0, "ipp://").otherwise(""), uri)).alias("host_port"),
        naming.host_slug(F.concat("c_mktsegment", F.lit(" Printer "), k.cast("string"))).alias("host_slug"),
    )


def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", naming.safe_name("text").alias("safe_name"))


def number_functions(spark, sf_dir):
    k = F.col("o_orderkey")
    n = k * 1000003 - 3000000000
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        numbers.wrap_i32(n).alias("wrapped"),
        numbers.k_octets(k * 100).alias("k_octets"),
        numbers.pages(k % 40).alias("pages"),
        numbers.human_size(k * 7919).alias("size"),
        numbers.code_hex((k % 65536).cast("int")).alias("code"),
        numbers.be_int(fixed(numbers.as_u32(n), 4)).alias("signed"),
        numbers.be_uint(fixed(k % 65536, 2)).alias("unsigned"),
    )


def announcement_records(spark, sf_dir):
    k = F.col("s_suppkey")
    record = device.txt_record(
        F.concat(F.lit("10.0.0."), (k % 256).cast("string")),
        F.lit(6310),
        F.lit("Virtual Printer"),
        F.format_string("%08d", k),
        F.col("s_name"),
    )
    return (
        table(spark, sf_dir, "supplier")
        .select("s_suppkey", F.explode(record).alias("property", "setting"))
        .select("s_suppkey", "property", "setting")
    )


def media_sizes(spark, sf_dir):
    size = F.struct(
        (20000 + F.col("p_size") * 10).alias("x_dimension"), (29000 + F.col("p_size") * 11).alias("y_dimension")
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(F.array(device.media_dims(size))))


def media_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p_partkey, body``: a message of a device that holds two sizes, three collections deep, and one ready size."""
    side = F.col("p_size")

    def integer(n: Column) -> Column:
        return attribute(codes.INTEGER, "", fixed(n, 4))

    def medium(x: Column, y: Column) -> Column:
        size = collection("", [("x-dimension", integer(x)), ("y-dimension", integer(y))])
        kind = attribute(codes.KEYWORD, "", text(F.lower("p_brand")))
        return collection("", [("media-size", size), ("media-type", F.concat(kind, kind))])

    both = [medium(20000 + side * 10, 29000 + side * 11), medium(10000 + side, 14000 + side)]
    ready = collection("media-size-ready", [("y-dimension", integer(side)), ("x-dimension", integer(side * 2))])
    body = F.concat(
        F.unhex(F.lit("0101000b00000001")),
        F.unhex(F.lit("04")),
        attribute(codes.TEXT, "printer-name", text(F.col("p_name"))),
        collection("media-col-database", [("media-col", F.concat(*both)), ("media-bottom-margin", integer(F.lit(0)))]),
        ready,
        F.unhex(F.lit("03")),
    )
    return table(spark, sf_dir, "part").select("p_partkey", body.alias("body"))


def media_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = media_messages(spark, sf_dir)
    values = attributes.explode_attributes(decode.decode_messages(messages), "p_partkey")
    return nested.nested_values(values, "p_partkey", tasks=tasks_for(messages, TOKENS_A_MESSAGE))


def nested_values(spark, sf_dir):
    held = media_values(spark, sf_dir)
    number = numbers.be_int(F.col("value")).cast("int")
    shown = (
        F.when(F.col("tag") == codes.INTEGER, number.cast("string"))
        .when(~F.col("opens"), F.col("value").cast("string"))
    )
    return held.select(
        "p_partkey", "attr_pos", "name", "place", "level", "collection", "member", "item", "tag", shown.alias("shown")
    )


def decoded_media_sizes(spark, sf_dir):
    sizes = nested.media_sizes(media_values(spark, sf_dir), "p_partkey")
    return sizes.select("p_partkey", "name", "place", "level", "width_mm", "height_mm")


# --- messages ------------------------------------------------------------------------


def decode_roundtrip(spark, sf_dir):
    decoded = decode.decode_messages(capture(request_log(spark, sf_dir, payload=True)))
    return decode.request_columns(decoded).select(
        "seq",
        "session_id",
        "major",
        "minor",
        "op_code",
        "request_id",
        "has_group",
        "job_name",
        "user_name",
        "document_format",
        "doc_bytes",
        "lookup_job_id",
    )


def long_headers(spark, sf_dir):
    """Whole documents as attribute values, in pieces the length field can hold: headers of any length."""
    k = F.col("doc_id")
    piece = 16000
    pieces = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length("text") / piece).cast("int"))),
        lambda i: attribute(codes.TEXT, "piece", text(F.substr(F.col("text"), (i - 1) * piece + 1, F.lit(piece)))),
    )
    empty = F.unhex(F.lit(""))
    body = F.concat(
        F.unhex(F.lit("0200000B")), fixed(k, 4), F.unhex(F.lit("01")), F.aggregate(pieces, empty, lambda all_before, this: F.concat(all_before, this)), F.unhex(F.lit("03"))
    )
    bodies = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    values = F.transform("tokens", lambda t: t["value"].cast("string"))
    return decode.decode_messages(bodies).select(
        "doc_id", "header_len", "doc_bytes", F.size("tokens").alias("pieces"), F.md5(F.array_join(values, "")).alias("digest")
    )


def document_tails(spark, sf_dir):
    decoded = decode.decode_messages(capture(request_log(spark, sf_dir, payload=True)))
    return decode.document_tail(decoded).select("seq", F.md5("document").alias("digest"))


def exploded_attributes(spark, sf_dir):
    decoded = decode.decode_messages(capture(request_log(spark, sf_dir, payload=True)))
    values = attributes.typed_values(attributes.explode_attributes(decoded, "seq"))
    return values.select("seq", "attr_pos", "name", "value_pos", "tag", "str_value", "int_value")


def rejects(spark, sf_dir):
    _, bad = decode.split_rejects(decode.decode_messages(damaged(spark, sf_dir)))
    return bad.select("seq", "error.reason", "error.need", "error.have")


def reject_rollup(spark, sf_dir):
    return rollups.reject_rollup(decode.decode_messages(damaged(spark, sf_dir)))


def judged(spark, sf_dir):
    # The HTTP columns follow from the message's own number: nothing is joined.
    messages = damaged(spark, sf_dir).withColumns(http_columns("seq"))
    return judged_messages(messages).select("seq", "http_status", "status", "reason")


def capture_registry(spark, sf_dir):
    """The whole way: stored bodies, judged requests, registry."""
    bodies = work_path(spark, "capture")
    capture(request_log(spark, sf_dir, payload=True)).write.parquet(bodies)
    requests = requests_from_capture(read_messages(spark, bodies, "parquet"), work_path(spark, "requests"))
    return registry_from_requests(requests, work_path(spark, "registry"))


def stored_messages(spark, sf_dir):
    path = work_path(spark, "capture")
    capture(request_log(spark, sf_dir, payload=True)).write.parquet(path)
    decoded = decode.decode_messages(read_messages(spark, path, "parquet"))
    return decoded.groupBy("code").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("doc_bytes").cast("bigint").alias("doc_bytes")
    )


# --- announcements -------------------------------------------------------------------


def announcements(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("device_id"), F.col("ts").cast("timestamp").alias("ts")
    )


def _in_micros(spans):
    return spans.select(
        "device_id",
        F.unix_micros("online_from").alias("online_from_us"),
        F.unix_micros("offline_at").alias("offline_at_us"),
        "announcements",
    )


def presence_intervals(spark, sf_dir, ttl=codes.RECORD_LIFETIME_SECONDS):
    return _in_micros(presence.presence_intervals(announcements(spark, sf_dir), ttl))


# --- streams -------------------------------------------------------------------------


def _append(stream: DataFrame, path: str, checkpoint: str) -> None:
    (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def streamed_admission(spark, sf_dir):
    bodies = damaged(spark, sf_dir)
    stream = read_message_stream(spark, arrivals(spark, bodies), bodies.schema, max_files=FILES_A_BATCH)
    path = work_path(spark, "admitted")
    _append(stream_admission(stream), path, work_path(spark, "checkpoint"))
    return spark.read.parquet(path).select("seq", "http_status", "status", "reason")


def streamed_registry(spark, sf_dir):
    path = work_path(spark, "registry")
    registry.stream_registry(arriving_log(spark, sf_dir), path, work_path(spark, "checkpoint")).awaitTermination()
    return registry.jobs_table(spark, path).drop("batch_id")


def streamed_capture(spark, sf_dir):
    """From bodies to jobs and rejects; the second batch fails half way, and the stream is started again."""
    bodies = damaged(spark, sf_dir)
    source, path, checkpoint = arrivals(spark, bodies), work_path(spark, "captured"), work_path(spark, "checkpoint")
    failures = [1]

    def stumble(batch: DataFrame, batch_id: int) -> None:
        if batch_id in failures:
            failures.remove(batch_id)
            raise RuntimeError("the second batch fails once, after its jobs were numbered")

    def run():
        stream = read_message_stream(spark, source, bodies.schema, max_files=FILES_A_BATCH)
        intake.stream_capture(stream, path, checkpoint, stumble).awaitTermination()

    try:
        run()
    except StreamingQueryException:
        run()
    jobs = registry.jobs_table(spark, path).select(
        F.lit("job").alias("kind"), F.col("created_seq").alias("seq"), "session_id", "job_id", "file_name", "size_bytes"
    )
    documents = intake.documents(spark, path).select("seq", F.md5("payload").alias("digest"))
    why = F.struct("error.*")
    bad = intake.rejects(spark, path).select(
        F.lit("reject").alias("kind"), "seq", "session_id", F.md5("body").alias("digest"), why.alias("why")
    )
    return (
        jobs.join(documents, "seq")
        .unionByName(bad, allowMissingColumns=True)
        .select("kind", "seq", "session_id", "job_id", "file_name", "size_bytes", "digest", "why.reason", "why.need", "why.have")
    )


def streamed_archive(spark, sf_dir):
    path = work_path(spark, "registry")
    log = arriving_log(spark, sf_dir, payload=True)
    registry.stream_archive(log, path, work_path(spark, "checkpoint")).awaitTermination()
    # Digests are made where the payloads lie, and get names; payloads do not move.
    archive = spark.read.parquet(f"{path}/archive").withColumn("digest", F.md5("payload")).drop("payload")
    return with_file_names(archive, registry.jobs_table(spark, path)).select(
        "session_id", "file_name", "size_bytes", "digest", F.date_format("day", "yyyy-MM-dd").alias("day")
    )


def archived_documents(spark, sf_dir):
    """A bulk archive written in place, its payloads' digests under registry names."""
    path = work_path(spark, "archive")
    archive_in_place(admission(request_log(spark, sf_dir, payload=True)), path)
    archive = spark.read.parquet(path).withColumn("digest", F.md5("payload")).drop("payload")
    listed = with_file_names(archive, jobs_of(spark, sf_dir))
    return listed.select(
        "session_id", "file_name", "size_bytes", F.unix_seconds("modified").alias("modified_s"), "digest"
    )


def archive_listing(spark, sf_dir):
    """An archive of named documents, written twice as a retried load would, and listed without its payloads."""
    placed, path = work_path(spark, "archive"), work_path(spark, "named-archive")
    archive_in_place(admission(request_log(spark, sf_dir, payload=True)), placed)
    named = with_file_names(spark.read.parquet(placed), jobs_of(spark, sf_dir))
    for _ in range(2):
        archive_documents(named, path)
    return list_archive(spark, path).select(
        "session_id", "file_name", "size_bytes", F.unix_seconds("modified").alias("modified_s")
    )


def id_blocks(spark, sf_dir):
    """Job ids counted over many small blocks, and over sequence numbers as far apart as time-based ones."""
    far = slim_log(spark, sf_dir).withColumn("seq", F.shiftleft("seq", 22))
    numbered = assign_job_ids(far, block_bits=24).where(F.col("status") == codes.OK)
    return numbered.select("session_id", "job_id", F.shiftright("seq", 22).alias("created_seq"))


def value_blocks(spark, sf_dir):
    return attributes.value_islands(token_rows(spark, sf_dir), block_bits=8).select("msg", "grp", "pos", "attr_pos")


def streamed_lookups(spark, sf_dir):
    path = work_path(spark, "registry")
    log = arriving_log(spark, sf_dir)
    registry.stream_lookup(log, path, work_path(spark, "checkpoint"), PRINTER_URI).awaitTermination()
    return spark.read.schema(registry.ANSWERS).parquet(f"{path}/answers").drop("batch_id")


def streamed_listing(spark, sf_dir):
    path = work_path(spark, "registry")
    registry.stream_listing(arriving_log(spark, sf_dir), path, work_path(spark, "checkpoint")).awaitTermination()
    return registry.newest_page(spark, path).select("session_id", "position", "file_name", "size_bytes", "files")


def streamed_notices(spark, sf_dir):
    """Notices of a job stream, as a consumer table received them."""
    jobs = jobs_of(spark, sf_dir)
    source = work_path(spark, "jobs")
    jobs.write.parquet(source)
    told = work_path(spark, "notices")
    stream = read_message_stream(spark, source, jobs.schema, max_files=2)
    notify_jobs(
        stream,
        "/archive",
        lambda notices, batch_id: registry.write_batch(notices, told, batch_id),
        work_path(spark, "checkpoint"),
    ).awaitTermination()
    return spark.read.parquet(told).drop("batch_id")


def told_notices(spark, sf_dir):
    """Notices of a job stream through the committed sink, run a second time over all that was told."""
    jobs = jobs_of(spark, sf_dir)
    source, told, checkpoint = (work_path(spark, label) for label in ("jobs", "told", "checkpoint"))
    jobs.write.parquet(source)
    for files in (1, 2):
        # The second run finds everything told.
        stream = read_message_stream(spark, source, jobs.schema, max_files=files)
        write_notices(stream, "/archive", told, checkpoint).awaitTermination()
    return committed_notices(spark, told, notice(jobs, "/archive").schema).drop("batch_id")


def late_announcements(spark, sf_dir):
    """Announcements up to 100 seconds out of order, over several batches."""
    heard = announcements(spark, sf_dir)
    begun = heard.agg(F.min(F.unix_seconds("ts")).alias("at")).first()["at"]
    late = F.pmod(F.xxhash64("device_id", "ts"), F.lit(100))
    staged = heard.withColumn("due", F.unix_seconds("ts") - F.lit(begun) + late)
    return read_message_stream(spark, arrivals(spark, staged, "due"), staged.schema, max_files=FILES_A_BATCH).drop("due")


def _with_settings(spark: SparkSession, settings: dict[str, str], run) -> None:
    """Run with the settings of a long-running stream, and put back those of the session."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        run()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def streamed_presence(spark, sf_dir, ttl=3600):
    """Spans that have ended, and those still open."""
    stream = late_announcements(spark, sf_dir)
    path, checkpoint = work_path(spark, "presence"), work_path(spark, "checkpoint")
    merged = {k: v for k, v in STREAM_SETTINGS.items() if "sessionWindow" in k}
    _with_settings(spark, merged, lambda: _append(stream_presence(stream, ttl, "2 minutes"), path, checkpoint))
    return _in_micros(spark.read.parquet(path).unionByName(open_spans(spark, checkpoint, ttl)))


def streamed_presence_changes(spark, sf_dir, ttl=3600):
    """Devices coming on line and going off, as far as the last watermark settles them."""
    stream = late_announcements(spark, sf_dir)
    path, checkpoint = work_path(spark, "changes"), work_path(spark, "checkpoint")
    changes = stream_presence_changes(stream, ttl, "2 minutes")
    _with_settings(spark, STREAM_SETTINGS, lambda: _append(changes, path, checkpoint))
    return spark.read.schema(changes.schema).parquet(path).select(
        "device_id",
        "change",
        F.unix_micros("at").alias("at_us"),
        F.unix_micros("online_from").alias("online_from_us"),
        "announcements",
    )


REPORTS = {
    "gate_status": gate_status,
    "admission": admission_report,
    "dispatch": dispatch_report,
    "request_rollup": request_rollup,
    "code_names": code_names,
    "job_registry": job_registry,
    "id_gaps": id_gaps,
    "job_lookup": lookup_report,
    "print_answers": print_report,
    "status_ok": status_report,
    "device_attributes": device_report,
    "attribute_query": attribute_query,
    "attribute_answers": attribute_answers,
    "dated_answers": dated_answers,
    "requested_attributes": requested_attributes,
    "first_value": first_value,
    "first_group": first_group,
    "value_islands": value_islands,
    "grouped_values": grouped_values,
    "typed_values": typed_values,
    "newest_page": partial(listing_page, k=0),
    "later_page": partial(listing_page, k=3),
    "deep_page": partial(listing_page, k=300),
    "indexed_page": partial(indexed_page, k=2),
    "newest_first": newest_first,
    "page_numbers": page_numbers,
    "archive_counts": archive_counts,
    "catalogue_from_names": catalogue_from_names,
    "display_columns": display_columns,
    "name_functions": name_functions,
    "safe_names": safe_names,
    "number_functions": number_functions,
    "announcement_records": announcement_records,
    "media_sizes": media_sizes,
    "nested_values": nested_values,
    "decoded_media_sizes": decoded_media_sizes,
    "decode_roundtrip": decode_roundtrip,
    "long_headers": long_headers,
    "document_tails": document_tails,
    "exploded_attributes": exploded_attributes,
    "split_rejects": rejects,
    "reject_rollup": reject_rollup,
    "judged_messages": judged,
    "read_messages": stored_messages,
    "capture_registry": capture_registry,
    "archive_documents": archived_documents,
    "list_archive": archive_listing,
    "id_blocks": id_blocks,
    "value_blocks": value_blocks,
    "presence_intervals": partial(presence_intervals, ttl=3600),
    "presence_record_lifetime": presence_intervals,
    "stream_admission": streamed_admission,
    "stream_registry": streamed_registry,
    "stream_archive": streamed_archive,
    "stream_capture": streamed_capture,
    "stream_lookup": streamed_lookups,
    "stream_listing": streamed_listing,
    "notify_jobs": streamed_notices,
    "committed_notices": told_notices,
    "stream_presence": streamed_presence,
    "stream_presence_changes": streamed_presence_changes,
}
