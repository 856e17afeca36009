"""Notices through the committed sink: told once, whatever fails and is tried again."""

import os

import pyarrow as pa
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from platenlog.sources.messages import read_message_stream
from platenlog.sources.notices import ForeignSink, NoticeWriter, committed_notices, write_notices

JOBS = "session_id STRING, job_id BIGINT, file_name STRING, size_bytes BIGINT"
NOTICES = "job_id BIGINT, file_path STRING, file_name STRING, size_bytes BIGINT, session_id STRING"


@pytest.fixture
def stored(spark, tmp_path):
    """Three arrivals of forty jobs, eight files each."""
    source = str(tmp_path / "in")
    for k in range(3):
        rows = spark.range(40 * k, 40 * k + 40, numPartitions=8)
        jobs = rows.select(F.lit("s").alias("session_id"), F.col("id").alias("job_id"), F.concat("id", F.lit(".pdf")).alias("file_name"), (F.col("id") + 1).alias("size_bytes"))
        jobs.write.mode("append").parquet(source)
    return source, str(tmp_path / "told"), str(tmp_path / "cp")


def stream_of(spark, source):
    return read_message_stream(spark, source, JOBS, max_files=8)


def told(spark, path):
    return sorted(tuple(r) for r in committed_notices(spark, path, NOTICES).select("job_id", "file_path", "size_bytes", "session_id", "batch_id").collect())


def all_jobs(n=120):
    return [(k, f"/a/{k}.pdf", k + 1, "s") for k in range(n)]


def files(path, folder="files"):
    return sorted(f for f in os.listdir(f"{path}/{folder}") if not f.startswith((".", "_")))


def test_failing_task_leaves_nothing(spark, stored, tmp_path):
    source, path, checkpoint = stored
    mended = str(tmp_path / "mended")

    @F.udf("bigint")
    def break_once(job_id):
        if job_id == 57 and not os.path.exists(mended):
            raise ValueError("broken")
        return job_id

    def run():
        write_notices(stream_of(spark, source).withColumn("job_id", break_once("job_id")), "/a", path, checkpoint).awaitTermination()

    with pytest.raises(StreamingQueryException):
        run()
    before = told(spark, path)
    # The batch with the fault has told nothing, also not what its sound tasks had written.
    assert 57 not in [r[0] for r in before] and len(files(path, "commits")) == len({r[-1] for r in before})
    open(mended, "w").close()
    run()
    assert [r[:4] for r in told(spark, path)] == all_jobs()
    assert len(files(path, "commits")) == 3


def test_replayed_batch_tells_once(spark, stored):
    source, path, checkpoint = stored
    write_notices(stream_of(spark, source), "/a", path, checkpoint).awaitTermination()
    before, held = told(spark, path), files(path)
    assert [r[:4] for r in before] == all_jobs()
    # The sink has committed, but the stream did not get to note it.
    last = max(int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{checkpoint}/commits/{name}")
    write_notices(stream_of(spark, source), "/a", path, checkpoint).awaitTermination()
    assert told(spark, path) == before and files(path) == held
    assert committed_notices(spark, path, NOTICES, after=last).count() == 0
    with pytest.raises(ForeignSink):
        write_notices(stream_of(spark, source), "/a", path, checkpoint + "-other")


def test_attempts_of_one_task(spark, tmp_path):
    """Two attempts write, one is named; a killed one leaves half a file that is never read."""
    path = f"file:{tmp_path}/told"
    writer = NoticeWriter(path)
    rows = pa.RecordBatch.from_pydict({"job_id": [1, 2], "file_path": ["a", "b"], "file_name": ["a", "b"], "size_bytes": [1, 2], "session_id": ["s", "s"]})
    first, second, none = writer.write(iter([rows])), writer.write(iter([rows])), writer.write(iter([]))
    assert none.name is None
    writer.commit([second, none, None], 0)
    assert sorted(r.job_id for r in committed_notices(spark, path, NOTICES).collect()) == [1, 2]
    writer.commit([first], 0)
    assert files(f"{tmp_path}/told") == [second.name]
    writer.commit([], 1)
    assert committed_notices(spark, path, NOTICES).count() == 2
