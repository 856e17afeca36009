"""Device capabilities: the snapshot of a device, and stored snapshots as a long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platenlog.functions import codes
from platenlog.functions.naming import host_port

A4 = (
    "{media-size={x-dimension=21000 y-dimension=29700} media-bottom-margin=0 media-left-margin=0 "
    "media-right-margin=0 media-top-margin=0 media-type=stationery}"
)
LETTER = (
    "{media-size={x-dimension=21590 y-dimension=27940} media-bottom-margin=0 media-left-margin=0 "
    "media-right-margin=0 media-top-margin=0 media-type=stationery}"
)
COLLECTION = 0x34

# The attributes of a device in the order they are sent, with tag
# and values as text. A value that starts with a colon is the device's own.
CAPABILITIES = [
    ("printer-uri-supported", codes.URI, [":uri"]),
    ("uri-security-supported", codes.KEYWORD, ["none"]),
    ("uri-authentication-supported", codes.KEYWORD, ["none"]),
    ("printer-name", codes.NAME, [":name"]),
    ("printer-make-and-model", codes.TEXT, [":model"]),
    ("printer-state", codes.ENUM, ["3"]),
    ("printer-state-reasons", codes.KEYWORD, ["none"]),
    ("ipp-versions-supported", codes.KEYWORD, ["1.0", "1.1", "2.0"]),
    ("ipp-features-supported", codes.KEYWORD, ["ipp-everywhere", "airprint-2.0"]),
    ("operations-supported", codes.ENUM, ["2", "4", "9", "11"]),
    ("charset-configured", codes.CHARSET, ["utf-8"]),
    ("charset-supported", codes.CHARSET, ["utf-8"]),
    ("natural-language-configured", codes.NATURAL_LANGUAGE, ["en"]),
    ("generated-natural-language-supported", codes.NATURAL_LANGUAGE, ["en"]),
    ("document-format-default", codes.MIME_TYPE, ["application/pdf"]),
    (
        "document-format-supported",
        codes.MIME_TYPE,
        ["application/pdf", "image/urf", "image/pwg-raster", "image/jpeg"],
    ),
    ("pdf-versions-supported", codes.KEYWORD, ["adobe-1.4"]),
    ("printer-is-accepting-jobs", codes.BOOLEAN, ["true"]),
    ("queued-job-count", codes.INTEGER, ["0"]),
    ("pdl-override-supported", codes.KEYWORD, ["not-attempted"]),
    ("printer-up-time", codes.INTEGER, [":up_time"]),
    ("compression-supported", codes.KEYWORD, ["none"]),
    ("color-supported", codes.BOOLEAN, ["false"]),
    ("sides-supported", codes.KEYWORD, ["one-sided"]),
    ("sides-default", codes.KEYWORD, ["one-sided"]),
    ("print-color-mode-default", codes.KEYWORD, ["monochrome"]),
    ("print-color-mode-supported", codes.KEYWORD, ["monochrome"]),
    ("orientation-requested-default", codes.ENUM, ["3"]),
    ("orientation-requested-supported", codes.ENUM, ["3", "4"]),
    ("output-bin-default", codes.KEYWORD, ["face-up"]),
    ("output-bin-supported", codes.KEYWORD, ["face-up"]),
    ("printer-resolution-default", codes.RESOLUTION, ["300x300x3"]),
    ("printer-resolution-supported", codes.RESOLUTION, ["300x300x3"]),
    ("multiple-document-jobs-supported", codes.BOOLEAN, ["false"]),
    (
        "job-creation-attributes-supported",
        codes.KEYWORD,
        [
            "copies", "document-format", "job-name", "media", "media-col", "orientation-requested",
            "print-color-mode", "print-quality", "printer-resolution", "sides",
        ],
    ),
    ("printer-info", codes.TEXT, [":info"]),
    ("printer-location", codes.TEXT, [":location"]),
    ("printer-more-info", codes.URI, [":more_info"]),
    ("media-default", codes.KEYWORD, ["iso_a4_210x297mm"]),
    ("media-supported", codes.KEYWORD, ["iso_a4_210x297mm", "na_letter_8.5x11in"]),
    ("media-col-default", COLLECTION, [A4]),
    ("media-col-database", COLLECTION, [A4, LETTER]),
    ("media-col-ready", COLLECTION, [A4]),
    ("media-ready", codes.KEYWORD, ["iso_a4_210x297mm"]),
    ("copies-default", codes.INTEGER, ["1"]),
    ("copies-supported", codes.RANGE_OF_INTEGER, ["1-1"]),
    ("page-ranges-supported", codes.BOOLEAN, ["false"]),
    ("print-quality-default", codes.ENUM, ["4"]),
    ("print-quality-supported", codes.ENUM, ["4"]),
    ("printer-uuid", codes.URI, [":uuid"]),
    ("urf-supported", codes.KEYWORD, ["CP1", "W8", "RS300"]),
    ("pwg-raster-document-resolution-supported", codes.RESOLUTION, ["300x300x3"]),
    ("pwg-raster-document-sheet-back", codes.KEYWORD, ["normal"]),
    ("pwg-raster-document-type-supported", codes.KEYWORD, ["sgray-8"]),
]


def device_snapshots(devices: DataFrame) -> DataFrame:
    """Each device with its attributes as one array.

    ``devices`` has ``device_id, uri, name, model, info, location, uuid,
    up_time``; up time is the epoch second of the snapshot.
    """
    own = {
        ":uri": F.col("uri"),
        ":name": F.col("name"),
        ":model": F.col("model"),
        ":info": F.col("info"),
        ":location": F.col("location"),
        ":more_info": F.concat(F.lit("http://"), host_port("uri"), F.lit("/")),
        ":uuid": F.concat(F.lit("urn:uuid:"), F.col("uuid")),
        ":up_time": F.col("up_time").cast("string"),
    }

    def value(tag: int, text: str) -> Column:
        return F.struct(F.lit(tag).alias("tag"), own.get(text, F.lit(text)).alias("value"))

    attributes = [
        F.struct(
            F.lit(pos).alias("pos"),
            F.lit(name).alias("name"),
            F.array(*[value(tag, text) for text in values]).alias("values"),
        )
        for pos, (name, tag, values) in enumerate(CAPABILITIES, start=1)
    ]
    return devices.select("device_id", F.array(*attributes).alias("attributes"))


def explode_devices(snapshots: DataFrame) -> DataFrame:
    """One row per device, attribute and value."""
    return (
        snapshots.select("device_id", F.inline("attributes"))
        .select("device_id", "pos", "name", F.posexplode("values").alias("at", "held"))
        .select(
            "device_id", "pos", "name", (F.col("at") + 1).alias("value_pos"), "held.tag", "held.value"
        )
    )


def device_attributes(spark: SparkSession, path: str) -> DataFrame:
    """Stored snapshots as a long table."""
    return explode_devices(spark.read.parquet(path))
