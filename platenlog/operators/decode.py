"""Bulk decode of captured messages, and what follows from it without a shuffle.

A decoded message stays one row: its tokens are an array next to the body, so
first-wins look-ups and the request columns are array expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platenlog.functions import codes
from platenlog.functions.numbers import be_int
from platenlog.operators.walk import WALKED_TYPE, read_headers

# Bytes of a body that are read at first, and where the header goes on, next; at last all.
PREFIXES = (1 << 10, 1 << 20)
HEADER_COLUMNS = ["major", "minor", "code", "request_id", "header_len", "groups", "tokens"]


def decode_messages(df: DataFrame, body: str = "body", prefixes: tuple[int, ...] = PREFIXES) -> DataFrame:
    """Add header columns, ``groups``, ``tokens``, ``doc_bytes`` and ``error`` (NULL when sound).

    Python gets the first of ``prefixes`` of every body, and of the few whose header
    goes on behind it the next one, so a message is walked once in the common
    case and never sent whole for a byte too much. Document bytes never come back: the body
    column stays on the JVM side and ``document_tail`` cuts it by ``header_len``.

    The steps are declared not deterministic, so that a filter on decoded
    columns does not make Spark run them a second time below itself.
    """
    read = F.arrow_udf(read_headers, WALKED_TYPE).asNondeterministic()
    held = F.coalesce(F.col(body), F.unhex(F.lit("")))  # a missing body is an empty one
    total = F.octet_length(held).cast("bigint")
    walked, steps = df.withColumn("_total", total), []
    for step, prefix in enumerate([*prefixes, None]):
        part = held if prefix is None else F.substring(held, 1, prefix)
        if steps:
            part = F.when(F.coalesce(*steps).isNull(), part)
        walked = walked.withColumn(f"_walked{step}", read(part, F.col("_total")))
        steps.append(F.col(f"_walked{step}"))
    w = F.col("_walked")
    error = F.struct(w["reason"].alias("reason"), w["need"].alias("need"), w["have"].alias("have"))
    return walked.withColumn("_walked", F.coalesce(*steps)).select(
        *df.columns,
        *[w[c].alias(c) for c in HEADER_COLUMNS],
        (F.col("_total") - w["header_len"]).alias("doc_bytes"),
        F.when(w["reason"].isNotNull(), error).alias("error"),
    )


def split_rejects(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound messages, and the ones to set aside with the reason.

    Two filters on one frame: write or persist the decoded frame first when both
    are to be consumed.
    """
    good = decoded.where(F.col("error").isNull()).drop("error")
    bad = decoded.where(F.col("error").isNotNull()).drop(*HEADER_COLUMNS, "doc_bytes")
    return good, bad


def document_tail(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``document``: the bytes after the header."""
    return df.withColumn("document", F.substr(F.col(body), (F.col("header_len") + 1).cast("int")))


def operation_group() -> Column:
    """Position of the first operation group; NULL when the message has none."""
    return F.nullif(F.array_position("groups", codes.OPERATION_GROUP), F.lit(0)).cast("int")


def first_token(name: str, group: Column | None = None) -> Column:
    """First value of the first attribute of that name in a group, by default the operation group."""
    at = operation_group() if group is None else group
    return F.get(
        F.filter("tokens", lambda t: (t["group_pos"] == at) & (t["name"] == name) & (t["value_pos"] == 1)), F.lit(0)
    )


def wanted_attributes(group: Column | None = None) -> Column:
    """Keywords of every requested-attributes in the group; NULL asks for everything."""
    at = operation_group() if group is None else group
    # Values added to an attribute have its number but no name.
    own = F.transform(
        F.filter("tokens", lambda t: (t["group_pos"] == at) & (t["name"] == "requested-attributes")),
        lambda t: t["attr_no"],
    )
    asked = F.filter("tokens", lambda t: F.array_contains(own, t["attr_no"]) & (t["tag"] == codes.KEYWORD))
    words = F.transform(asked, lambda t: t["value"].cast("string"))
    return F.when(F.size(words) > 0, words)


def request_columns(decoded: DataFrame) -> DataFrame:
    """The columns admission and look-ups read, from decoded messages; every input column is kept."""
    group = F.col("_group")
    named = decoded.withColumn("_group", operation_group()).withColumns(
        {
            "_name": first_token("job-name", group),
            "_user": first_token("requesting-user-name", group),
            "_format": first_token("document-format", group),
            "_job": first_token("job-id", group),
            "wanted": wanted_attributes(group),
        }
    )

    def text(token: str, tags: list[int], default: str) -> Column:
        value = F.col(f"{token}.value").cast("string")
        return F.coalesce(F.when(F.col(f"{token}.tag").isin(*tags), value), F.lit(default))

    names = [codes.TEXT, codes.NAME]
    job_id = be_int(F.substr(F.col("_job.value"), F.lit(1), F.lit(4)))
    return named.withColumns(
        {
            "op_code": F.col("code"),
            "has_group": F.col("_group").isNotNull(),
            "job_name": text("_name", names, "Untitled"),
            "user_name": text("_user", names, "unknown"),
            "document_format": text("_format", [codes.MIME_TYPE], codes.DEFAULT_FORMAT),
            "lookup_job_id": F.when(F.col("_job.tag") == codes.INTEGER, job_id),
        }
    ).drop("_group", "_name", "_user", "_format", "_job")
