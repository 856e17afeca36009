"""Hard negatives: the best rows of another label inside a window below each positive's score.

Scores are whole numbers and exact. Anchors and rows meet in blocks: a block of
anchors and a slot of rows are one unit of work, whose size is bounded by bytes.

First every unit hands on each anchor's best rows of its own label, of which the best of all
are its positives. Then it hands on, for each positive, the best rows of other labels
inside the positive's window; no row beyond those of its own unit can be among the answers.
What is handed on is packed into one key of bytes, (anchor, descending score, id), dealt by anchor and
sorted within its partitions by that key. One pass down an anchor's scores then
opens a window at each positive and emits negatives until the window is full or the scores fall
below it, so that nothing is held but the open windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platenlog.plans.session import work_path

POSITIVES = 5
NEGATIVES = 10
# A negative's score is between these hundredths of the positive's.
FROM, UPTO = 30, 90
SCALE = 256
# Bytes of a block of anchors and of a slot of rows, eight to a component; scores computed at once.
ANCHOR_BYTES = 4 << 20
SLOT_BYTES = 16 << 20
AT_ONCE = 4 << 20

LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1

SCORED = "anchor_id bigint, vec_id bigint, score bigint"
PACKED = "anchor_id bigint, key binary"
MINED = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
)


def usable_rows(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """``vec_id, label, vector``: one row for each id that has a usable one."""

    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    own = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    sound = own.where(F.forall("vector", finite))
    best = sound.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("own"))
    return best.select("vec_id", "own.label", "own.vector")


def whole_numbers(rows: pa.Table) -> np.ndarray:
    """floor(256 x) of every component, as doubles, which hold it exactly."""
    column = rows["vector"].combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def inner_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no sum can leave what they hold, else in longs, else in integers of any size."""
    largest = [float(np.abs(m).max(initial=0.0)) for m in (anchors, rows)]
    most = largest[0] * largest[1] * anchors.shape[1]
    if most < 2**53:
        return (anchors @ rows.T).astype(np.int64)
    if most < 2**62:
        return anchors.astype(np.int64) @ rows.astype(np.int64).T
    exact = [np.vectorize(int, otypes=[object])(m) for m in (anchors, rows)]
    # No result column holds more; scores beyond are held at its ends.
    return np.clip(exact[0] @ exact[1].T, LONG_MIN, LONG_MAX).astype(np.int64)


def best_first(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best scores, ties by the smaller id."""
    if len(score) > most:
        cut = np.partition(score, len(score) - most)[len(score) - most]
        places = np.flatnonzero(score >= cut)
    else:
        places = np.arange(len(score))
    # ~x falls as x rises, and unlike -x for every long.
    return places[np.lexsort((ids[places], ~score[places]))][:most]


def _answer(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    """Rows of an anchor's id, and ids and scores that were found for it."""
    empty = [np.zeros(0, np.int64)]
    return pa.table(
        {
            "anchor_id": pa.array(np.concatenate([np.full(len(i), a) for a, i, _ in found] or empty), pa.int64()),
            "vec_id": pa.array(np.concatenate([i for _, i, _ in found] or empty), pa.int64()),
            "score": pa.array(np.concatenate([s for _, _, s in found] or empty), pa.int64()),
        }
    )


def scored_blocks(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(place of an anchor, its scores with all rows) for one anchor after the other."""
    left, right = whole_numbers(anchors), whole_numbers(rows)
    step = max(1, AT_ONCE // max(1, len(right)))
    for k in range(0, len(left), step):
        for n, score in enumerate(inner_products(left[k : k + step], right)):
            yield k + n, score


def positives(met: DataFrame, rows: DataFrame, count: int) -> DataFrame:
    """``anchor_id, scores, ids``: each anchor's best rows of its label, best first."""

    def look(anchor_rows: pa.Table, slot_rows: pa.Table) -> pa.Table:
        if not anchor_rows.num_rows or not slot_rows.num_rows:
            return _answer([])
        found = []
        labels, own = slot_rows["label"].to_numpy(), anchor_rows["label"].to_numpy()
        for label in np.unique(own):
            at, here = np.flatnonzero(own == label), np.flatnonzero(labels == label)
            some, others = anchor_rows.take(pa.array(at)), slot_rows.take(pa.array(here))
            if not len(here):
                continue
            ids = others["vec_id"].to_numpy()
            names = some["vec_id"].to_numpy()
            for k, score in scored_blocks(some, others):
                other = ids != names[k]
                best = best_first(score[other], ids[other], count)
                found.append((names[k], ids[other][best], score[other][best]))
        return _answer(found)

    keys = ["dims", "block", "slot"]
    near = met.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(look, SCORED)
    order = W.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    best = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)
    listed = F.array_sort(F.collect_list(F.struct("place", "score", "vec_id")))
    return best.groupBy("anchor_id").agg(listed.alias("best")).select(
        "anchor_id", F.col("best.score").alias("scores"), F.col("best.vec_id").alias("ids")
    )


def negatives(met: DataFrame, rows: DataFrame, count: int, low: int, high: int) -> DataFrame:
    """``anchor_id, vec_id, score``: rows of other labels that may be among the answers, each once for a unit of work."""

    def look(anchor_rows: pa.Table, slot_rows: pa.Table) -> pa.Table:
        if not anchor_rows.num_rows or not slot_rows.num_rows:
            return _answer([])
        found = []
        names, own = anchor_rows["vec_id"].to_numpy(), anchor_rows["label"].to_numpy()
        ids, labels = slot_rows["vec_id"].to_numpy(), slot_rows["label"].to_numpy()
        for k, score in scored_blocks(anchor_rows, slot_rows):
            taken: set[int] = set()
            other = labels != own[k]
            for positive in anchor_rows["scores"][k].as_py():
                least, most = bounds(positive, low, high)
                inside = np.flatnonzero(other & (score >= least) & (score <= most)) if least <= most else ()
                if len(inside):
                    taken.update(inside[best_first(score[inside], ids[inside], count)].tolist())
            places = np.array(sorted(taken), dtype=np.int64)
            found.append((names[k], ids[places], score[places]))
        return _answer(found)

    keys = ["dims", "block", "slot"]
    return met.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(look, SCORED)


def bounds(positive: int, low: int, high: int) -> tuple[int, int]:
    """The least and the largest whole score inside a positive's window, held within a long."""
    return max(-(-low * positive // 100), LONG_MIN), min(high * positive // 100, LONG_MAX)


def packed(scored: DataFrame, is_negative: bool) -> DataFrame:
    """(anchor, descending score, positives first, id) as bytes that sort in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, ids, score = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            flip = np.uint64(1 << 63)
            key = np.zeros((len(anchor), 25), dtype=np.uint8)
            for at, numbers in (
                (0, anchor.view(np.uint64) ^ flip),
                (8, ~(score.view(np.uint64) ^ flip)),
                (17, ids.view(np.uint64) ^ flip),
            ):
                key[:, at : at + 8] = numbers.astype(">u8")[:, None].view(np.uint8)
            key[:, 16] = is_negative
            whole = key.tobytes()
            keys = [whole[k : k + 25] for k in range(0, len(whole), 25)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], ["anchor_id", "key"])

    return scored.mapInArrow(run, PACKED)


def opened(keys: Iterator[bytes], count: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Down the sorted keys: a window for each positive, and the negatives that fall into it."""
    flip = 1 << 63
    current, windows = None, []
    for key in keys:
        anchor, ids = (int.from_bytes(key[k : k + 8], "big") - flip for k in (0, 17))
        score = flip - 1 - int.from_bytes(key[8:16], "big")
        if anchor != current:
            current, windows = anchor, []
        if not key[16]:
            windows.append([ids, score, 0, *bounds(score, low, high)])
            continue
        # Below its least score, or full, a window is done with.
        windows = [w for w in windows if w[2] < count and score >= w[3]]
        for window in windows:
            if score <= window[4]:
                window[2] += 1
                yield anchor, window[0], window[2], ids, window[1], score


def mine_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positive_count: int = POSITIVES,
    negative_count: int = NEGATIVES,
    low: int = FROM,
    high: int = UPTO,
    anchor_bytes: int = ANCHOR_BYTES,
    slot_bytes: int = SLOT_BYTES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` has the ids (``vec_id``) of rows of ``vectors``; other ids are ignored. A score is the inner
    product of the vectors' whole parts of 256 times each component; higher ones come
    first, ties by the smaller id. An anchor's positives are its first ``positive_count`` other rows of the
    same label; for each, the first ``negative_count`` rows of other labels with low * positive <= 100 *
    negative <= high * positive, from rank 1. A positive score below 0 has no such row.

    Rows with a null id, label or vector, or a null or non-finite component take no part. Of rows that share
    an id the one with the smallest label, then vector, counts. Rows of different lengths are not compared.
    Scores beyond a long are held at its ends. Other columns are ignored; empty tables give no rows.
    """
    spark = vectors.sparkSession
    path = work_path(spark, "mined-rows")
    usable_rows(vectors, vec_id, vector, label).withColumn("dims", F.size("vector")).write.parquet(path)
    rows = spark.read.parquet(path)
    own = anchors.select(F.col(vec_id).cast("bigint").alias("vec_id")).distinct()
    # Columns of their own, as both sides come from the same rows.
    own = spark.read.parquet(path).join(own, "vec_id", "left_semi")

    # Units of work by bytes, for vectors of one length.
    sizes = rows.groupBy("dims").agg((F.count(F.lit(1)) * F.greatest(F.col("dims"), F.lit(1)) * 8).alias("bytes"))
    asked = own.groupBy("dims").agg((F.count(F.lit(1)) * F.greatest(F.col("dims"), F.lit(1)) * 8).alias("asked"))
    units = sizes.join(asked, "dims").select(
        "dims",
        F.ceil(F.col("bytes") / slot_bytes).cast("int").alias("slots"),
        F.ceil(F.col("asked") / anchor_bytes).cast("int").alias("blocks"),
    )
    # One row for each length of vectors.
    path = work_path(spark, "mined-units")
    units.write.parquet(path)
    units = spark.read.parquet(path)
    place = F.xxhash64("vec_id")
    slot, block = (F.pmod(place, F.col(c)).cast("int") for c in ("slots", "blocks"))
    all_slots, all_blocks = (F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("slots", "blocks"))
    dealt = (
        rows.join(units, "dims")
        .select("dims", "vec_id", "label", "vector", slot.alias("slot"), all_blocks.alias("block"))
    )
    sent = own.join(units, "dims").select("dims", "vec_id", "label", "vector", block.alias("block"), all_slots.alias("slot"))

    path = work_path(spark, "mined-positives")
    positives(sent, dealt, positive_count).write.parquet(path)
    best = spark.read.schema("anchor_id bigint, scores array<bigint>, ids array<bigint>").parquet(path)
    hopeful = sent.join(best.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    pairs = negatives(hopeful, dealt, negative_count, low, high)
    firsts = best.select("anchor_id", F.explode(F.arrays_zip("ids", "scores")).alias("one")).select(
        "anchor_id", F.col("one.ids").alias("vec_id"), F.col("one.scores").alias("score")
    )
    keyed = packed(firsts, False).unionByName(packed(pairs, True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (key.as_py() for batch in batches for key in batch.column(1))
        out = []
        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        kinds = [pa.int32() if name == "rank" else pa.int64() for name in names]

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)], names
            )

        for row in opened(keys, negative_count, low, high):
            out.append(row)
            if len(out) == 10_000:
                yield made()
                out = []
        yield made()

    # The secondary sort: dealt by anchor, in order of the packed key.
    return keyed.repartition("anchor_id").sortWithinPartitions("key").mapInArrow(run, MINED)
