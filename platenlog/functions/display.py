"""Columns a document listing shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from platenlog.functions.numbers import _col


def icon_extension(name: Column | str) -> Column:
    """Lower-case text after the last dot; a name without a dot counts as a whole."""
    return F.lower(F.substring_index(_col(name), ".", -1))


def extension(name: Column | str) -> Column:
    """Lower-case text after the last dot; empty when there is none."""
    return F.when(F.contains(_col(name), F.lit(".")), icon_extension(name)).otherwise(F.lit(""))


def mime_of(ext: Column | str) -> Column:
    return (
        F.when(_col(ext) == "pdf", "application/pdf")
        .when(_col(ext) == "ps", "application/postscript")
        .otherwise("*/*")
    )


def kind_of(ext: Column | str) -> Column:
    """Icon shown for a file: a page, a printer or a folder."""
    return (
        F.when(_col(ext) == "pdf", "\U0001F4C4")
        .when(_col(ext) == "ps", "\U0001F5A8")
        .otherwise("\U0001F4C1")
    )


def short_stamp(millis: Column | str) -> Column:
    """Month, day and minute of an epoch-millisecond column, in the session time zone."""
    return F.date_format(F.timestamp_millis(_col(millis)), "MM/dd HH:mm")
