"""Captured message bodies made from the request log, with Spark's own binary functions.

The decode jobs read such tables; here they come from the log, so the log is
what a decode must give back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platenlog.functions import codes


def fixed(n: Column, width: int) -> Column:
    """An unsigned integer as ``width`` big-endian bytes."""
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 2 * width, "0"))


def attribute(tag: int, name: str, value: Column) -> Column:
    """Tag, name and value with their lengths; ``value`` is BINARY."""
    head = f"{tag:02x}{len(name.encode()):04x}{name.encode().hex()}"
    return F.concat(F.unhex(F.lit(head)), fixed(F.octet_length(value), 2), value)


def text(value: Column) -> Column:
    return F.encode(value, "utf-8")


def collection(name: str, members: list[tuple[str, Column]]) -> Column:
    """A collection under an attribute's name, or without one as a further or a nested value.

    Members have a name and the bytes of their values, each without a name of its own.
    """
    empty = F.unhex(F.lit(""))
    parts = [part for own, held in members for part in (attribute(codes.MEMBER_NAME, "", text(F.lit(own))), held)]
    return F.concat(
        attribute(codes.BEGIN_COLLECTION, name, empty), *parts, attribute(codes.END_COLLECTION, "", empty)
    )


def unless(absent: Column, part: Column) -> Column:
    """A part that is left out where ``absent`` holds."""
    return F.when(absent, F.unhex(F.lit(""))).otherwise(part)


def attributes(log: DataFrame) -> list[tuple[int, str, Column, Column | None]]:
    """Tag, name and value of what a message says, in order, and where it is left out."""
    return [
        (codes.CHARSET, "attributes-charset", text(F.lit("utf-8")), None),
        (codes.NATURAL_LANGUAGE, "attributes-natural-language", text(F.lit("en")), None),
        (codes.URI, "printer-uri", text(F.lit("ipp://192.0.2.1:6310/ipp/print")), None),
        (codes.NAME, "requesting-user-name", text(F.col("user_name")), F.col("user_name") == "unknown"),
        (codes.NAME, "job-name", text(F.col("job_name")), F.col("job_name") == "Untitled"),
        (codes.MIME_TYPE, "document-format", text(F.col("document_format")), F.col("document_format") == codes.DEFAULT_FORMAT),
        (codes.INTEGER, "job-id", fixed(F.coalesce("lookup_job_id", F.lit(0)), 4), F.col("lookup_job_id").isNull()),
    ]


def header(log: DataFrame) -> Column:
    """Everything up to and including the end marker."""
    parts = [
        attribute(tag, name, value) if absent is None else unless(absent, attribute(tag, name, value))
        for tag, name, value, absent in attributes(log)
    ]
    fixed_part = [F.unhex(F.lit("0101")), fixed(F.col("op_code"), 2), fixed(F.col("seq"), 4)]
    return F.concat(*fixed_part, F.unhex(F.lit("01")), *parts, F.unhex(F.lit("03")))


def text_places(log: DataFrame) -> tuple[Column, Column]:
    """Where in a body the names are, and the values that are texts: arrays of (start, length), from 0."""
    names, texts = [], []
    at = F.lit(9)
    for tag, name, value, absent in attributes(log):
        held = F.lit(True) if absent is None else ~absent
        size = F.octet_length(value)
        own = len(name.encode())
        names.append(F.when(held, F.struct((at + 3).alias("start"), F.lit(own).alias("length"))))
        if tag != codes.INTEGER:
            texts.append(F.when(held, F.struct((at + 5 + own).alias("start"), size.alias("length"))))
        at = at + F.when(held, 5 + own + size).otherwise(0)
    return F.array_compact(F.array(*names)), F.array_compact(F.array(*texts))


def capture(log: DataFrame, *more: str) -> DataFrame:
    """``seq, session_id, arrived_at, avail_bytes, body`` for every request of a log with payloads, and columns named."""
    document = unless(F.col("doc_bytes") == 0, F.col("payload"))
    return log.select(
        "seq", "session_id", "arrived_at", "avail_bytes", F.concat(header(log), document).alias("body"), *more
    )
