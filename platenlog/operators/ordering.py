"""Numbering rows in order within a key, without one task per key.

A window partitioned by the key alone puts a whole session or device into one
task. Both operators here cut each key into blocks first: rows are numbered
inside their block, and the block totals, a much smaller table, give each
block its starting point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platenlog.plans.session import shared_folder

BLOCK_BITS = 20
LEVEL_BITS = 22
FIRST_BLOCK = -(1 << 63)
# Rows that one task sorts, about, where a table is larger than the session's partitions are made for.
TASK_ROWS = 1 << 19


def tasks_for(df: DataFrame, each: int = 1) -> int | None:
    """So many partitions as keep a task at about ``TASK_ROWS`` rows; None where the session's are enough.

    Counts the rows; ``each`` is how many rows will come of one.
    """
    needed = -(-df.count() * each // TASK_ROWS)
    return needed if needed > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: str,
    amount: Column,
    name: str,
    block_bits: int = BLOCK_BITS,
    opening: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over the rows of the key up to this one.

    ``opening`` (the keys and a last column) gives keys a balance to start from; ``tasks`` is how many
    partitions the blocks are dealt to, if not as many as the session names.

    ``order`` is an integer that no two rows of a key share, so a block (equal
    high bits) holds at most ``2**block_bits`` rows whatever the key holds. Blocks
    are summed in levels the same way: the blocks of one group, the groups of one larger
    group, so that no window holds more than ``2**LEVEL_BITS`` rows of a key even if every block
    holds one row, as with ids made from the time. The block is a function of
    the row alone: both sides of the join agree however often they are computed.
    Keys must not be NULL.
    """
    block = F.shiftright(F.col(order).cast("bigint"), block_bits)
    amount = amount.cast("bigint")
    df = df.withColumn("_block", block)
    if tasks:
        df = df.repartition(tasks, *keys, "_block")
    blocks = df.groupBy(*keys, "_block").agg(F.sum(amount).alias("_total"))
    if opening is not None:
        # One more block per key, before all others.
        balance = F.col(opening.columns[-1]).cast("bigint").alias("_total")
        blocks = blocks.unionByName(opening.select(*keys, F.lit(FIRST_BLOCK).alias("_block"), balance))
    if tasks:
        blocks = blocks.repartition(tasks, *keys)
    starts = _starts(blocks, keys, block_bits).where(F.col("_before") != 0)
    inside = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    # Most keys fit one block and have no start to add; where all do, the right
    # side is empty at run time and adaptive execution drops the join.
    return (
        df.withColumn("_inside", F.sum(amount).over(inside))
        .join(starts, [*keys, "_block"], "left")
        .withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_inside"))
        .drop("_block", "_inside", "_before")
    )


def _starts(blocks: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """``_block, _before``: the sum of the totals of a key's earlier blocks, level by level."""
    group = F.shiftright("_block", LEVEL_BITS)
    last = bits + LEVEL_BITS >= 64
    peers = [*keys] if last else [*keys, "_group"]
    earlier = W.partitionBy(*peers).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    inside = blocks.withColumn("_group", group).withColumn(
        "_inside", F.coalesce(F.sum("_total").over(earlier), F.lit(0))
    )
    if last:
        return inside.select(*keys, "_block", F.col("_inside").alias("_before"))
    groups = blocks.groupBy(*keys, group.alias("_block")).agg(F.sum("_total").alias("_total"))
    above = _starts(groups, keys, bits + LEVEL_BITS).where(F.col("_before") != 0)
    above = above.select(*keys, F.col("_block").alias("_group"), F.col("_before").alias("_above"))
    return inside.join(above, [*keys, "_group"], "left").select(
        *keys, "_block", (F.col("_inside") + F.coalesce("_above", F.lit(0))).alias("_before")
    )


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the place of each row in its key under any total order, from 1.

    The rows are range-partitioned on key and order, so a hot key is spread over
    as many tasks as its share of the rows. They are checkpointed there, because
    range bounds come from a sample and must not be drawn twice; pass slim rows.
    """
    shared_folder(df.sparkSession)
    # Runs when it is called: the bounds must be drawn once, before anything reads them.
    place = [F.col(k) for k in keys] + order
    placed = (
        df.repartitionByRange(*place)
        .sortWithinPartitions(*place)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
        .checkpoint()
    )
    parts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(
        *keys, "_part", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    return (
        placed.join(starts, [*keys, "_part"])
        .withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1)
        .drop("_at", "_part", "_first", "_before")
    )
