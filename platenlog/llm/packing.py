"""Length buckets with the least padding, and batches of a token budget inside them.

A global histogram of lengths, one count per length up to ``max_len``, goes through
dynamic programming, which finds the ``buckets`` upper bounds with the smallest
total padding when every sequence is padded to the bound of its bucket. Inside a
bucket, batches take as many sequences as the token budget allows at that bound.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platenlog.plans.session import shared_folder

MAX_LEN = 2048
BUCKETS = 8
BUDGET = 16_384
BLOCK_ROWS = (256, 100_000)
# Lengths whose cuts are tried at once, each against all shorter ones.
LENGTHS = 64


def word_count(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def best_bounds(counts: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds, ascending, of at most ``buckets`` buckets with the least padding.

    Only lengths that occur can be bounds of a best choice. Among equals, the
    choice whose last buckets reach furthest down is taken.
    """
    lengths = sorted(counts)
    if not lengths:
        return []
    size = np.array(lengths, dtype=np.int64)
    rows = np.cumsum([0, *(counts[n] for n in lengths)], dtype=np.int64)
    m = len(lengths)
    # Padded tokens of a bucket over lengths i to j; the real tokens are the same for any choice.
    best = size * rows[1:]
    cuts = []
    for _ in range(min(buckets, m) - 1):
        # The last bucket starts behind length i: all buckets before it end at i.
        cut, better = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
        # Some lengths at a time, as all against all would be the most that the driver holds.
        for k in range(0, m, LENGTHS):
            to = np.arange(k, min(k + LENGTHS, m))
            cost = best[:, None] + (rows[None, to + 1] - rows[1:, None]) * size[None, to]
            cost[np.arange(m)[:, None] >= to] = np.iinfo(np.int64).max
            cut[to] = cost.argmin(axis=0)
            better[to] = cost[cut[to], np.arange(len(to))]
        cuts.append(np.where(better < best, cut, -1))
        best = np.minimum(better, best)
    bounds, at = [], m - 1
    for cut in reversed(cuts):
        if cut[at] >= 0:
            bounds.append(lengths[at])
            at = int(cut[at])
    bounds.append(lengths[at])
    return bounds[::-1]


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    max_len: int = MAX_LEN,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    block_rows: tuple[int, int] = BLOCK_ROWS,
) -> DataFrame:
    """``doc_id, piece, first_word, n_tokens, bucket, bucket_len, batch, place``, one row per piece.

    A document of n words is a sequence of n + 1 tokens (the last one ends it); it
    is cut into pieces of ``max_len`` tokens, so nothing is left out and the
    histogram never has more than ``max_len`` rows. ``bucket`` counts from 0,
    ``batch`` counts from 0 inside a bucket and ``place`` from 0 inside a batch. A
    batch of bound b holds ``max(1, budget // b)`` pieces, but for the last one of
    its bucket. Pieces stand in the order of the MD5 of their id and piece number,
    so batches are mixed and the same on every run.

    A null or empty text is one piece of one token. A null id sorts with the MD5 of
    an empty id; repeated rows are packed one by one. Other columns are ignored;
    an empty table gives no rows.

    Numbering a bucket takes no task per bucket: rows are numbered inside blocks
    of their sort order, whose number follows the row count, and block totals add
    the rest. Texts are read once; slim rows are checkpointed.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    n = (word_count(F.coalesce(F.col(text), F.lit(""))) + 1).cast("bigint")
    measured = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), n.alias("n")).checkpoint()
    last = F.floor((F.col("n") - 1) / max_len)
    pieces = measured.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece")).select(
        "doc_id",
        "piece",
        (F.col("piece") * max_len).alias("first_word"),
        F.least(F.lit(max_len).cast("bigint"), F.col("n") - F.col("piece") * max_len).alias("n_tokens"),
    )
    histogram = {r.n_tokens: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}
    bounds = best_bounds(histogram, buckets)
    total = sum(histogram.values())
    each = min(max(total // 4096, block_rows[0]), block_rows[1])
    blocks = max(1, -(-total // each))
    bucket = F.lit(0)
    for bound in bounds[:-1]:
        bucket = bucket + (F.col("n_tokens") > bound).cast("int")
    bucket_len = F.element_at(F.array(*[F.lit(b).cast("bigint") for b in bounds or [1]]), F.col("bucket") + 1)
    mark = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece").cast("string")))
    # The first 28 bits of the order, cut into equal stretches.
    block = F.floor(F.conv(F.substring("mark", 1, 7), 16, 10).cast("bigint") * blocks / (1 << 28))
    rows = (
        pieces.withColumn("bucket", bucket)
        .withColumn("bucket_len", bucket_len)
        .withColumn("mark", mark)
        .withColumn("block", block)
    )
    counts = rows.groupBy("bucket", "block").agg(F.count("*").alias("rows"))
    earlier = W.partitionBy("bucket").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select("bucket", "block", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first"))
    inside = W.partitionBy("bucket", "block").orderBy("mark", "doc_id", "piece", "n_tokens")
    number = F.col("first") + F.row_number().over(inside) - 1
    batch_rows = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(budget) / F.col("bucket_len")))
    return (
        rows.join(firsts, ["bucket", "block"])
        .withColumn("number", number)
        .select(
            "doc_id",
            "piece",
            "first_word",
            "n_tokens",
            "bucket",
            "bucket_len",
            F.floor(F.col("number") / batch_rows).alias("batch"),
            (F.col("number") % batch_rows).alias("place"),
        )
    )
