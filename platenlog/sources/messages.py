"""Captured message bodies, at rest and arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BODY_FILE_COLUMNS = {"message": "path", "arrived_at": "modificationTime", "body_bytes": "length", "body": "content"}


def _body_files(files: DataFrame) -> DataFrame:
    return files.select(*[F.col(held).alias(name) for name, held in BODY_FILE_COLUMNS.items()])


def read_messages(spark: SparkSession, path: str, file_format: str = "binaryFile") -> DataFrame:
    """One row per message: one body per file, or a table with a ``body BINARY`` column."""
    loaded = spark.read.format(file_format).load(path)
    return _body_files(loaded) if file_format == "binaryFile" else loaded


def read_message_stream(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    file_format: str = "parquet",
    max_files: int = 1000,
) -> DataFrame:
    """The same as files arrive, at most ``max_files`` per micro-batch."""
    reader = spark.readStream.format(file_format).option("maxFilesPerTrigger", max_files)
    if file_format == "binaryFile":
        return _body_files(reader.load(path))
    return reader.schema(schema).load(path)
