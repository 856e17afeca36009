"""From a capture to a registry, with every body read once; a rerun replaces what it wrote.

Numbering reads its input twice, so what it reads is a written table of slim
request rows and never the capture itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from platenlog.operators.jobs import assign_job_ids, register_jobs
from platenlog.streaming.admission import stream_admission


def requests_from_capture(messages: DataFrame, path: str) -> DataFrame:
    """Judge a table of messages into a table of requests without documents, and read that back."""
    stream_admission(messages).write.mode("overwrite").parquet(path)
    return messages.sparkSession.read.parquet(path)


def registry_from_requests(requests: DataFrame, path: str) -> DataFrame:
    """Number and register the requests, and read the registry back."""
    register_jobs(assign_job_ids(requests)).write.mode("overwrite").parquet(path)
    return requests.sparkSession.read.parquet(path)
