"""Merged runs: every batch in exactly one run, the newest row of a key, bounded files, replays and gaps."""

import random

import pytest
from pyspark.sql import functions as F

from platenlog.sources import folders
from platenlog.streaming import registry, runs
from tests.test_streams import NOON, SCHEMA, URI, rows_of

BATCHES = 20


def test_live_runs_hold_each_batch_once():
    for base in (2, 3, 8):
        for batch_id in [*range(200), 8**5 + 3]:
            live = runs.live_runs(batch_id, base)
            held = [range(number * base**level, (number + 1) * base**level) for level, number in live]
            # Newest first, end to end, without a gap.
            assert [r.stop for r in held] == [batch_id, *[r.start for r in held]][: len(held)]
            assert not held or held[-1].start == 0
            levels = {level for level, _ in live}
            assert all(sum(level == a for a, _ in live) < base for level in levels)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """A table of 20 batches of a few keys each, its source, and what it held before each batch."""
    path = str(tmp_path_factory.mktemp("runs"))
    draw = random.Random(4)
    source = [{f"k{draw.randrange(40)}": draw.randrange(1000) for _ in range(5)} for _ in range(BATCHES)]

    def derive(session, first, last):
        newest = {}
        for changes in source[first : last + 1]:
            newest.update(changes)
        return session.createDataFrame(sorted(newest.items()), "key STRING, value BIGINT")

    held = runs.Runs(path, "key STRING, value BIGINT", ["key"], lambda: F.xxhash64("key"), derive, base=3, buckets=4)
    for batch_id, changes in enumerate(source):
        held.write(spark.createDataFrame(list(changes.items()), "key STRING, value BIGINT"), batch_id)
    return held, source


def before(source, batch_id):
    newest = {}
    for changes in source[:batch_id]:
        newest.update(changes)
    return newest


def test_newest_row_of_a_key(spark, table):
    held, source = table
    assert held.last_batch(spark) == BATCHES - 1
    for batch_id in (0, 1, 17, 18, 19, 20):
        assert {r.key: r.value for r in held.read(spark, batch_id).collect()} == before(source, batch_id)
    asked = spark.createDataFrame([("k1",), ("k2",), ("none",)], "key STRING")
    want = {k: v for k, v in before(source, 20).items() if k in ("k1", "k2")}
    assert {r.key: r.value for r in held.matching(asked, 20).collect()} == want


def test_files_opened_are_bounded(spark, table):
    """A bucket is a folder in each live run, and there are fewer runs than ``base`` on a level."""
    held, _ = table
    for batch_id in (9, 17, 20):
        live = runs.live_runs(batch_id, 3)
        for bucket in range(4):
            assert len(held.files(spark, live, [bucket])) <= len(live) <= 6
        opened = held._held(spark, live, [1]).inputFiles()
        assert len(opened) <= len(live) and all("/bucket=1/" in f for f in opened)


def test_spent_runs_go(spark, table):
    held, _ = table
    kept = {int(n.split("=")[1]) for n in folders.names(spark, f"{held.path}/level=0") if n.startswith("run=")}
    # But for the first few, which another test has asked for again.
    assert set(range(BATCHES - 6, BATCHES)) <= kept and not kept & set(range(5, BATCHES - 6))


def test_runs_that_are_gone_are_made_again(spark, table):
    """Put back further than runs are kept, and a run that was cut off."""
    held, source = table
    assert {r.key: r.value for r in held.read(spark, 5).collect()} == before(source, 5)
    folders.remove(spark, f"{held.path}/level=0/run=19/_SUCCESS")
    assert held.last_batch(spark) == 18
    assert {r.key: r.value for r in held.read(spark, 20).collect()} == before(source, 20)
    assert held.last_batch(spark) == 19


def test_batches_write_what_they_change(spark, tmp_path):
    """One busy session among hundreds: its batch writes one counter, one page, and opens one bucket of jobs."""
    path = str(tmp_path / "out")
    steps = [registry.registry_step(spark, path), registry.lookup_step(spark, path, URI), registry.listing_step(spark, path)]

    def request(seq, session, op=2, asked=None):
        return (seq, session, NOON, op, "n", "u", None, 5, asked, None)

    batches = [
        [request(k, f"s{k}") for k in range(300)],
        [request(1000, "s7"), request(1001, "s7", 9, 1), request(1002, "s7", 9, 2), request(1003, "s8", 9, 9)],
    ]
    for batch_id, rows in enumerate(batches):
        for step in steps:
            step(spark.createDataFrame(rows, SCHEMA), batch_id)
    for name in ("counters", "newest"):
        assert [spark.read.parquet(f"{path}/{name}/level=0/run={k}").count() for k in (0, 1)] == [300, 1]
    answers = spark.read.schema(registry.ANSWERS).parquet(f"{path}/answers").collect()
    assert sorted((r.seq, r.status, r.job_id) for r in answers) == [(1001, 0, 1), (1002, 0, 2), (1003, 0x0406, None)]
    index = registry.job_index(path)
    asked = spark.createDataFrame([("s7", 1)], "session_id STRING, job_id BIGINT")
    opened = index.matching(asked, 2).inputFiles()
    assert 1 <= len(opened) <= 2
    assert rows_of(index.matching(asked, 2).select("created_seq")) == [(7,)]
    # A session with very many jobs lies in as many buckets as it has stretches.
    far = spark.range(0, 100).select(F.lit("hot").alias("session_id"), (F.col("id") * registry.STRETCH).alias("job_id"))
    assert far.select(index.bucket()).distinct().count() > 30
