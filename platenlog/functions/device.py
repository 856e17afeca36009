"""Device values: protocol date-times, announcement properties, media sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from platenlog.functions.numbers import _col

# Announcement properties every device shares.
ANNOUNCED = [
    ("txtvers", "1"),
    ("pdl", "application/pdf,image/urf,image/pwg-raster,image/jpeg"),
    ("rp", "ipp/print"),
    ("Color", "F"),
    ("Duplex", "F"),
    ("Fax", "F"),
    ("Scan", "F"),
    ("Copies", "F"),
    ("PaperMax", "legal-A4"),
    ("URF", "CP1,W8,RS300"),
]


def device_time(value: Column | str) -> Column:
    """Protocol date-time struct to TIMESTAMP; NULL where a field is out of range.

    The wire form is local time plus the sign, hours and minutes of its offset,
    so the instant is the local time read as UTC less that offset.
    """
    v = _col(value)
    local = F.try_make_timestamp(
        v["year"],
        v["month"],
        v["day"],
        v["hour"],
        v["minutes"],
        v["seconds"] + v["deci_seconds"].cast("decimal(4,1)") / 10,
        F.lit("UTC"),
    )
    sign = F.when(v["direction"] == 43, 1).when(v["direction"] == 45, -1)
    sound = (v["deci_seconds"] < 10) & (v["offset_hours"] < 15) & (v["offset_minutes"] < 60)
    offset = F.make_dt_interval(hours=sign * v["offset_hours"], mins=sign * v["offset_minutes"])
    return F.when(sound, local - offset)


def txt_record(ip: Column | str, port: Column | str, model: Column | str, uuid: Column | str, note: Column | str) -> Column:
    """The properties one announcement carries, as a MAP."""
    pairs = [F.lit(text) for entry in ANNOUNCED for text in entry]
    own = [
        F.lit("ty"), _col(model),
        F.lit("adminurl"), F.concat(F.lit("http://"), _col(ip), F.lit(":"), _col(port).cast("string"), F.lit("/")),
        F.lit("UUID"), _col(uuid),
        F.lit("note"), _col(note),
    ]
    return F.create_map(*pairs, *own)


def media_dims(size: Column | str) -> Column:
    """Media size struct (hundredths of a millimetre) to millimetres."""
    s = _col(size)
    return F.struct(
        (s["x_dimension"] / F.lit(100)).alias("width_mm"), (s["y_dimension"] / F.lit(100)).alias("height_mm")
    )
