"""Keyed tables of a stream: a run of rows per batch, merged with its like by powers of a base.

Batch n writes run n of level 0, which holds what it has changed and nothing else. When ``base`` runs
of a level are full they are merged into one run of the next level, so a row is written again once
a level and not once a batch. Which runs make up the table before batch n follows from the
digits of n, so nothing keeps account of them: a batch that is run again writes and reads the same.

Inside a run rows lie in buckets by a hash of what they are looked up by. A batch reads the buckets it asks
for, of at most ``base - 1`` runs a level, and opens no other file.

Runs are taken away when their level has gone on by twice ``base``; a batch that needs one that is gone,
or was never written, makes it again from the table's source, which is kept by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from platenlog.sources import folders

BASE = 8
BUCKETS = 64

Derive = Callable[[SparkSession, int, int], DataFrame]


def live_runs(batch_id: int, base: int = BASE) -> list[tuple[int, int]]:
    """(level, number) of the runs that hold batches 0 to ``batch_id`` - 1, newest first."""
    runs, level, left = [], 0, batch_id
    while left:
        runs += [(level, left - 1 - k) for k in range(left % base)]
        left //= base
        level += 1
    return runs


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty frame that the optimizer sees is empty."""
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)]
    return spark.range(1).select(*columns).where(F.lit(False))


class Runs(NamedTuple):
    """A keyed table under ``path``: ``schema`` names its columns, ``keys`` those of which the newest row counts.

    ``spread`` is what rows are dealt to buckets by. ``derive(spark, first, last)`` makes the rows of a run
    of batches ``first`` to ``last`` from the source. With ``written_once`` no key has two rows.
    """

    path: str
    schema: str
    keys: list[str]
    spread: Callable[[], Column]
    derive: Derive
    written_once: bool = False
    base: int = BASE
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(self.spread(), F.lit(self.buckets)).cast("int")

    def matching(self, asked: DataFrame, batch_id: int) -> DataFrame:
        """The rows before batch ``batch_id`` whose keys are in ``asked``, which has the keys, once each."""
        spark = asked.sparkSession
        if not batch_id:
            return no_rows(spark, self.schema)
        # At most as many numbers as there are buckets.
        buckets = [r.bucket for r in asked.select(self.bucket().alias("bucket")).distinct().collect()]
        return self.read(spark, batch_id, buckets).join(asked, self.keys, "left_semi")

    def _run(self, level: int, number: int) -> str:
        return f"{self.path}/level={level}/run={number}"

    def _put(self, rows: DataFrame, level: int, number: int) -> None:
        """Replace a run as a whole, in files of a sensible size."""
        dealt = rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(self._run(level, number))
        folders.remove(rows.sparkSession, self._run(level, number - 2 * self.base))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """What this batch has changed, and the merges that it completes."""
        spark = rows.sparkSession
        self._put(rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")), 0, batch_id)
        level, number = 1, batch_id + 1
        while number % self.base == 0:
            number //= self.base
            below = [(level - 1, (number - 1) * self.base + k) for k in range(self.base)]
            self._put(self._newest(self._held(spark, below)), level, number - 1)
            level += 1

    def _newest(self, rows: DataFrame) -> DataFrame:
        if self.written_once:
            return rows
        values = [c for c in rows.columns if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_newest"))
        return newest.select(*self.keys, *[F.col(f"_newest.{c}").alias(c) for c in values])

    def files(self, spark: SparkSession, runs: Iterable[tuple[int, int]], buckets: list[int] | None = None) -> list[str]:
        """The folders of the buckets asked for, of runs of which all are there after this."""
        asked = None if buckets is None else {f"bucket={b}" for b in buckets}
        found = []
        for level, number in runs:
            run = self._run(level, number)
            held = folders.names(spark, run)
            if folders.FINISHED not in held:
                size = self.base**level
                last = (number + 1) * size - 1
                rows = self.derive(spark, number * size, last)
                self._put(rows.withColumn("batch_id", F.lit(last).cast("bigint")), level, number)
                held = folders.names(spark, run)
            found += [f"{run}/{n}" for n in held if n.startswith("bucket=") and (asked is None or n in asked)]
        return found

    def _held(self, spark: SparkSession, runs: Iterable[tuple[int, int]], buckets: list[int] | None = None) -> DataFrame:
        schema = f"{self.schema}, batch_id BIGINT"
        paths = self.files(spark, runs, buckets)
        return spark.read.schema(schema).parquet(*paths) if paths else no_rows(spark, schema)

    def read(self, spark: SparkSession, batch_id: int, buckets: list[int] | None = None) -> DataFrame:
        """The table before batch ``batch_id``, a row a key; only the ``buckets`` asked for, if some are named."""
        return self._newest(self._held(spark, live_runs(batch_id, self.base), buckets)).drop("batch_id")

    def last_batch(self, spark: SparkSession) -> int:
        """The last batch whose runs are all written, -1 if there is none."""
        begun = [int(n.split("=")[1]) for n in folders.names(spark, f"{self.path}/level=0") if n.startswith("run=")]
        for batch_id in sorted(begun, reverse=True):
            if all(folders.finished(spark, self._run(*run)) for run in live_runs(batch_id + 1, self.base)):
                return batch_id
        return -1
