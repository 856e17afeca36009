"""Device presence as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from platenlog.functions.codes import RECORD_LIFETIME_SECONDS


def stream_presence(
    announcements: DataFrame, ttl: int = RECORD_LIFETIME_SECONDS, delay: str = "2 minutes"
) -> DataFrame:
    """One row per span a device was on line, emitted once the watermark shows it has gone.

    Session windows join events up to and including their gap, while a record
    aged exactly ``ttl`` has expired. Timestamps count microseconds, so a gap one
    microsecond short of ``ttl`` joins exactly the right ones.
    """
    gap = f"{ttl - 1} seconds 999999 microseconds"
    spans = (
        announcements.withWatermark("ts", delay)
        .groupBy("device_id", F.session_window("ts", gap).alias("session"))
        .agg(F.min("ts").alias("online_from"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("announcements"))
    )
    return _shown(spans, ttl)


def _shown(spans: DataFrame, ttl: int) -> DataFrame:
    return spans.select(
        "device_id",
        "online_from",
        (F.col("last") + F.make_dt_interval(secs=F.lit(ttl))).alias("offline_at"),
        "announcements",
    )


def open_spans(spark: SparkSession, checkpoint: str, ttl: int = RECORD_LIFETIME_SECONDS) -> DataFrame:
    """The spans that :func:`stream_presence` still holds back, as of its last finished batch.

    Read from the stream's own state: with what it has emitted, these are the spans of all
    announcements so far. They may still grow.
    """
    held = spark.read.format("statestore").load(checkpoint).select("value.*")
    spans = held.select(
        "device_id", F.col("min").alias("online_from"), F.col("max").alias("last"), F.col("count").alias("announcements")
    )
    return _shown(spans, ttl)


class _Changes(StatefulProcessor):
    """One state row per device: its spans that are not settled yet, in order, in microseconds.

    A span is [first and last announcement, how many, whether its start was told]. An announcement that can
    still come is later than the watermark, so a start is settled once the watermark has
    reached it and an end once it has reached the expiry. One timer stands for the next of them.
    """

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        # With the time of the timer that is set, so that it need not be asked for: a call costs more than the rest.
        self.held = handle.getValueState(
            "spans", "spans ARRAY<STRUCT<a: BIGINT, b: BIGINT, n: BIGINT, told: BOOLEAN>>, due BIGINT"
        )

    def _read(self) -> tuple[list[list], int | None]:
        held = self.held.get()
        return ([list(span) for span in held[0]], held[1]) if held is not None else ([], None)

    def handleInputRows(self, key, rows, timerValues):
        heard = [us for frame in rows for us in frame["us"].tolist()]
        spans, due = self._read()
        merged: list[list] = []
        for a, b, n, told in sorted([*spans, *([us, us, 1, False] for us in heard)], key=lambda span: span[0]):
            # A record aged exactly its lifetime has expired.
            if merged and a < merged[-1][1] + self.ttl:
                merged[-1][1:3] = max(merged[-1][1], b), merged[-1][2] + n
            else:
                merged.append([a, b, n, told])
        yield from self._settle(key, merged, due, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        spans, _ = self._read()
        # The timer that has expired is gone.
        yield from self._settle(key, spans, None, timerValues.getCurrentWatermarkInMs())

    def _settle(self, key, spans: list[list], due: int | None, watermark: int) -> Iterator[pd.DataFrame]:
        now, out, left = watermark * 1000, [], []
        for a, b, n, told in spans:
            if a <= now and not told:
                out.append(("online", a, a, None))
            if b + self.ttl <= now:
                out.append(("offline", b + self.ttl, a, n))
            else:
                left.append((a, b, n, told or a <= now))
        if left:
            first = min(b + self.ttl if told else a for a, b, _, told in left)
            first = -(-first // 1000)
            if first != due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(first)
            self.held.update((left, first))
        else:
            if due is not None:
                self.handle.deleteTimer(due)
            self.held.clear()
        if out:
            made = pd.DataFrame(out, columns=["change", "at_us", "from_us", "announcements"])
            made.insert(0, "device_id", key[0])
            yield made.astype({"announcements": "Int64"})

    def close(self) -> None:
        pass


def stream_presence_changes(
    announcements: DataFrame, ttl: int = RECORD_LIFETIME_SECONDS, delay: str = "2 minutes"
) -> DataFrame:
    """A row when a device comes on line and one when it goes off, as soon as the watermark settles them.

    ``device_id, change, at, online_from, announcements``: ``online`` at a span's first announcement, told while the
    span goes on; ``offline`` one lifetime after its last, with how many there were. Announcements may come late and
    out of order by up to ``delay``: they extend or join spans that are not settled, and one after the expiry
    starts a new span. Spans are those of ``presence_intervals``. Needs the state store of
    ``STREAM_SETTINGS``.
    """
    kind = announcements.schema["device_id"].dataType.simpleString()
    heard = announcements.withWatermark("ts", delay).select("device_id", "ts", F.unix_micros("ts").alias("us"))
    changes = heard.groupBy("device_id").transformWithStateInPandas(
        statefulProcessor=_Changes(ttl),
        outputStructType=f"device_id {kind}, change STRING, at_us BIGINT, from_us BIGINT, announcements BIGINT",
        outputMode="Append",
        timeMode="EventTime",
    )
    return changes.select(
        "device_id",
        "change",
        F.timestamp_micros("at_us").alias("at"),
        F.timestamp_micros("from_us").alias("online_from"),
        "announcements",
    )
