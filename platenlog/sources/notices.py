"""Notices of stored jobs as a committed sink: a batch that is tried again tells a consumer once.

Every task writes what it has to a file of its own under ``files``; the driver names the files
of a whole batch in one small file under ``commits``, which appears at once. Notices count
when they are named there, so those of a killed, repeated or abandoned task never do, and a batch
that was committed and is played again adds nothing.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from platenlog.sources.documents import notice

# The sink travels inside the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "committed_notices"
COMMITS = "batch_id BIGINT, files ARRAY<STRING>"
OWNER = "owner STRING"


class ForeignSink(RuntimeError):
    """The sink holds the notices of another stream."""


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, in a store that pyarrow knows, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """The file a task has written; none where it had no rows."""

    name: str | None


class NoticeWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = _store(self.path)
        name, writer = f"{uuid.uuid4().hex}.parquet", None
        try:
            for batch in iterator:
                if batch.num_rows and writer is None:
                    store.create_dir(f"{path}/files", recursive=True)
                    writer = pq.ParquetWriter(f"{path}/files/{name}", batch.schema, filesystem=store)
                if batch.num_rows:
                    writer.write_batch(batch)
        finally:
            if writer is not None:
                writer.close()
        return Written(name if writer else None)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        store, path = _store(self.path)
        target = f"{path}/commits/{batchId}.json"
        if store.get_file_info(target).type != fs.FileType.NotFound:
            # Committed before the stream could note it down: what was told stays as it is.
            self.abort(messages, batchId)
            return
        store.create_dir(f"{path}/commits", recursive=True)
        named = {"batch_id": batchId, "files": [m.name for m in messages if m and m.name]}
        hidden = f"{path}/commits/.{uuid.uuid4().hex}"
        with store.open_output_stream(hidden) as out:
            out.write(json.dumps(named).encode())
        store.move(hidden, target)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        store, path = _store(self.path)
        for message in messages:
            if message and message.name:
                store.delete_file(f"{path}/files/{message.name}")


class NoticeSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema: StructType, overwrite: bool) -> NoticeWriter:  # noqa: N802
        return NoticeWriter(self.options["path"])


def _owner(spark: SparkSession, path: str) -> str | None:
    try:
        held = spark.read.schema(OWNER).parquet(f"{path}/owner").first()
    except AnalysisException:
        return None
    return held and held.owner


def _claim(spark: SparkSession, path: str, checkpoint: str) -> None:
    """Give the checkpoint a mark and the sink the same, or find that they have it."""
    mine, held = _owner(spark, checkpoint), _owner(spark, path)
    if held is not None and held != mine:
        raise ForeignSink(f"{path} holds the notices of another stream: a new checkpoint needs a new sink")
    mark = spark.range(1).select(F.lit(mine or uuid.uuid4().hex).alias("owner"))
    if mine is None:
        mark.write.mode("overwrite").parquet(f"{checkpoint}/owner")
    if held is None:
        spark.read.schema(OWNER).parquet(f"{checkpoint}/owner").write.mode("overwrite").parquet(f"{path}/owner")


def write_notices(jobs: DataFrame, directory: str, path: str, checkpoint: str) -> StreamingQuery:
    """Tell of the jobs of a stream: its notices (see ``notice``) under ``path``, each once, whatever is tried again.

    ``path`` is in a store that all executors reach and pyarrow knows (a shared folder, an object store). Tasks
    stream their rows to files and hold a batch of them at a time.
    """
    spark = jobs.sparkSession
    _claim(spark, path, checkpoint)
    spark.dataSource.register(NoticeSink)
    writer = notice(jobs, directory).writeStream.format(FORMAT).option("checkpointLocation", checkpoint)
    return writer.option("path", path).trigger(availableNow=True).start()


def committed_notices(spark: SparkSession, path: str, schema: StructType | str, after: int = -1) -> DataFrame:
    """The notices told, with the ``batch_id`` that told them, of batches after ``after``.

    Files and commits meet in a join by file name; files that no commit names are left out.
    """
    commits = spark.read.schema(COMMITS).json(f"{path}/commits").where(F.col("batch_id") > after)
    named = commits.select("batch_id", F.explode("files").alias("_file"))
    held = spark.read.schema(schema).parquet(f"{path}/files").withColumn("_file", F.col("_metadata.file_name"))
    return held.join(named, "_file").drop("_file")
