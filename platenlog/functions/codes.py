"""Code dimensions of the print protocol, and small broadcast tables of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Operation codes and their names.
OPERATIONS = [
    (0x0002, "Print-Job"),
    (0x0003, "Print-URI"),
    (0x0004, "Validate-Job"),
    (0x0005, "Create-Job"),
    (0x0006, "Send-Document"),
    (0x0008, "Cancel-Job"),
    (0x0009, "Get-Job-Attributes"),
    (0x000A, "Get-Jobs"),
    (0x000B, "Get-Printer-Attributes"),
    (0x000C, "Hold-Job"),
    (0x000D, "Release-Job"),
    (0x000E, "Restart-Job"),
    (0x0010, "Pause-Printer"),
    (0x0011, "Resume-Printer"),
    (0x0012, "Purge-Jobs"),
]

PRINT_JOB = 0x0002
VALIDATE_JOB = 0x0004
GET_JOB_ATTRIBUTES = 0x0009
GET_PRINTER_ATTRIBUTES = 0x000B
SERVED_OPERATIONS = [PRINT_JOB, VALIDATE_JOB, GET_JOB_ATTRIBUTES, GET_PRINTER_ATTRIBUTES]

# Status codes and their names.
STATUSES = [
    (0x0000, "successful-ok"),
    (0x0001, "successful-ok-ignored-or-substituted"),
    (0x0002, "successful-ok-conflicting-attributes"),
    (0x0400, "client-error-bad-request"),
    (0x0401, "client-error-forbidden"),
    (0x0402, "client-error-not-authenticated"),
    (0x0403, "client-error-not-authorized"),
    (0x0404, "client-error-not-possible"),
    (0x0405, "client-error-timeout"),
    (0x0406, "client-error-not-found"),
    (0x0407, "client-error-gone"),
    (0x0408, "client-error-request-entity-too-large"),
    (0x0409, "client-error-request-value-too-long"),
    (0x040A, "client-error-document-format-not-supported"),
    (0x040B, "client-error-attributes-or-values-not-supported"),
    (0x040C, "client-error-uri-scheme-not-supported"),
    (0x040D, "client-error-charset-not-supported"),
    (0x040E, "client-error-conflicting-attributes"),
    (0x0500, "server-error-internal-error"),
    (0x0501, "server-error-operation-not-supported"),
    (0x0502, "server-error-service-unavailable"),
    (0x0503, "server-error-version-not-supported"),
    (0x0504, "server-error-device-error"),
    (0x0505, "server-error-temporary-error"),
    (0x0506, "server-error-not-accepting-jobs"),
    (0x0507, "server-error-busy"),
    (0x0508, "server-error-job-canceled"),
    (0x0509, "server-error-multiple-document-jobs-not-supported"),
]

OK = 0x0000
BAD_REQUEST = 0x0400
NOT_FOUND = 0x0406
FORMAT_NOT_SUPPORTED = 0x040A
INTERNAL_ERROR = 0x0500
OPERATION_NOT_SUPPORTED = 0x0501

# The statuses a client names; every other code prints as hex.
CLIENT_STATUSES = [
    (0x0000, "successful-ok"),
    (0x0001, "successful-ok-ignored-or-substituted"),
    (0x0400, "client-error-bad-request"),
    (0x0404, "client-error-not-possible"),
    (0x040A, "client-error-document-format-not-supported"),
    (0x0500, "server-error-internal-error"),
    (0x0501, "server-error-operation-not-supported"),
]

# Group delimiters.
DELIMITERS = [
    (0x01, "operation-attributes"),
    (0x02, "job-attributes"),
    (0x03, "end-of-attributes"),
    (0x04, "printer-attributes"),
    (0x05, "unsupported-attributes"),
]
OPERATION_GROUP = 0x01

# Value tags.
VALUE_TAGS = [
    (0x10, "unsupported"),
    (0x12, "unknown"),
    (0x13, "no-value"),
    (0x21, "integer"),
    (0x22, "boolean"),
    (0x23, "enum"),
    (0x30, "octet-string"),
    (0x31, "date-time"),
    (0x32, "resolution"),
    (0x33, "range-of-integer"),
    (0x34, "begin-collection"),
    (0x35, "text-with-language"),
    (0x36, "name-with-language"),
    (0x37, "end-collection"),
    (0x41, "text-without-language"),
    (0x42, "name-without-language"),
    (0x44, "keyword"),
    (0x45, "uri"),
    (0x46, "uri-scheme"),
    (0x47, "charset"),
    (0x48, "natural-language"),
    (0x49, "mime-media-type"),
    (0x4A, "member-attribute-name"),
]

INTEGER = 0x21
BOOLEAN = 0x22
ENUM = 0x23
OCTET_STRING = 0x30
DATE_TIME = 0x31
RESOLUTION = 0x32
RANGE_OF_INTEGER = 0x33
TEXT = 0x41
NAME = 0x42
KEYWORD = 0x44
URI = 0x45
CHARSET = 0x47
NATURAL_LANGUAGE = 0x48
MIME_TYPE = 0x49
BEGIN_COLLECTION = 0x34
END_COLLECTION = 0x37
MEMBER_NAME = 0x4A
STRING_TAGS = [0x41, 0x42, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49]
OUT_OF_BAND_TAGS = [0x10, 0x13]

# Shortest payload each binary type can have.
SHORTEST_VALUE = {INTEGER: 4, ENUM: 4, DATE_TIME: 11, RESOLUTION: 9, RANGE_OF_INTEGER: 8}

# Job states.
JOB_STATES = [
    (3, "pending"),
    (5, "processing"),
    (7, "aborted"),
    (8, "canceled"),
    (9, "completed"),
]
COMPLETED = 9

# The formats that are stored when printed, and the one that is
# assumed when a request names none.
DEFAULT_FORMAT = "application/octet-stream"
STORED_FORMATS = ["application/pdf", DEFAULT_FORMAT]

# Status messages.
MESSAGE_OK = "successful-ok"
MESSAGE_NOT_SERVED = "server-error-operation-not-supported"
MESSAGE_NO_GROUP = "Missing operation-attributes"
MESSAGE_FORMAT = "Only application/pdf is accepted; retry with document-format-default"
MESSAGE_EMPTY = "No document data"
MESSAGE_SPACE = "Insufficient storage space"
MESSAGE_WRITE = "Failed to save document"
MESSAGE_NO_JOB_ID = "Missing job-id"
MESSAGE_NO_JOB = "Job not found"

# Limits.
MAX_BODY_BYTES = 512 * 1024 * 1024
SPACE_HEADROOM = 10 * 1024 * 1024
PAGE_SIZE = 5
RECORD_LIFETIME_SECONDS = 120


def code_table(spark: SparkSession, rows: list[tuple[int, str]], code: str, name: str) -> DataFrame:
    """A code dimension as a literal relation; at most 28 rows, so always broadcastable."""
    values = ", ".join(f"({value}, '{label}')" for value, label in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({code}, {name})")
