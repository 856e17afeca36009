"""Texts by what they say: a hash of 128 bits, and one row for each different text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTENT = ["c1", "c2"]


def content(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text; a null one is as an empty one."""
    own = F.coalesce(text, F.lit(""))
    return [F.xxhash64(own).alias("c1"), F.xxhash64(F.lit("second"), own).alias("c2")]


def one_of_each(rows: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """``c1, c2, text`` of the contents in ``wanted``, once each, from ``c1, c2, id, text``.

    Which copy of a text is taken is settled on ids, which combine before they are
    shuffled, and only that copy's text moves: a text that a third of all rows hold is one
    row. ``wanted`` has no repeats; it is broadcast if it has at most ``most`` rows.
    """
    first = rows.groupBy(*CONTENT).agg(F.min("id").alias("id")).join(wanted.select(*CONTENT), CONTENT, "left_semi")
    if wanted.count() <= most:
        first = F.broadcast(first)
    chosen = rows.join(first, [*CONTENT, "id"], "left_semi")
    # Rows that repeat with their id.
    return chosen.groupBy(*CONTENT).agg(F.first("text").alias("text"))
