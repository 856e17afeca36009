"""File names, URIs and host names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from platenlog.functions.numbers import _col

# What a stored name may keep, and how long it may be.
KEPT_IN_NAMES = r"[^\p{IsAlphabetic}\p{N}\-_.]"
NAME_LENGTH = 64


def safe_name(name: Column | str) -> Column:
    """Letters, digits and ``- _ .`` survive, anything else becomes ``_``; 64 characters at most."""
    # One character for one, so it is cut before it is cleaned.
    return F.regexp_replace(F.substring(_col(name), 1, NAME_LENGTH), KEPT_IN_NAMES, "_")


def file_name(epoch: Column | str, job_id: Column | str, name: Column | str) -> Column:
    """Stored file name: epoch second, job id, cleaned job name, always ``.pdf``."""
    return F.concat(
        _col(epoch).cast("string"), F.lit("_"), _col(job_id).cast("string"), F.lit("_"), safe_name(name), F.lit(".pdf")
    )


def printer_uri(ip: Column | str, port: Column | str) -> Column:
    return F.concat(F.lit("ipp://"), _col(ip), F.lit(":"), _col(port).cast("string"), F.lit("/ipp/print"))


def job_uri(printer: Column | str, job_id: Column | str) -> Column:
    return F.concat(_col(printer), F.lit("/jobs/"), _col(job_id).cast("string"))


def host_port(uri: Column | str) -> Column:
    """What stands between the (possibly repeated) scheme and the first slash."""
    return F.substring_index(F.regexp_replace(_col(uri), "^(ipp://)+", ""), "/", 1)


def host_slug(name: Column | str) -> Column:
    """Local host name a device announces itself under."""
    return F.concat(F.replace(F.lower(_col(name)), F.lit(" "), F.lit("-")), F.lit(".local."))
