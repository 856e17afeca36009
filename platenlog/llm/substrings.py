"""Removal of repeated substrings: every byte covered by a 200-byte string that also starts elsewhere.

The strings are compared on a Burrows-Wheeler transform (``bwt.py``), shard by shard. Which
parts of the corpus must meet in a shard is found by winnowing: of the grams of ``GRAM`` bytes in any
200-byte string, the one with the smallest hash is an anchor. Equal strings have equal
anchors at equal places, so a repeated string has an anchor that occurs more than once, and it
lies in the surroundings of that anchor: the bytes that a 200-byte string around it can reach.

1. Anchors, with a hash of their surroundings, are taken from all texts; only those are stored.
2. Anchors that occur once are dropped. Surroundings that occur more than once are repeated
   throughout, whoever else has the anchor.
3. Of the different surroundings of an anchor one each is cut into ``PARTS`` stretches of strings at fixed
   distances from the anchor. What all strings of a stretch share, its core, is hashed; equal strings
   have equal cores, so stretches whose core occurs once are dropped, and ones that occur again as a
   whole are repeated. One copy of each text asked for moves to be hashed, and again in step 4 to be cut.
4. One of each of the others goes, as text, to the shard of its core, where all with that core
   meet: overlapping ones of a text as one piece. This is the same at every size: an anchor
   that very many texts have is dealt out by what is beside it.
5. A core that over ``CROWD`` stretches have, more than fill a shard, is too much for one. Their strings
   are compared one by one by hashes of 128 bits, which are as exact and spread by themselves.

Copies of a text are one text in all of this; how often it occurs is part of step 2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platenlog.llm.bwt import repeated_starts
from platenlog.llm.content import CONTENT, content, one_of_each
from platenlog.plans.session import shared_folder, work_path
from platenlog.sources.folders import remove

LENGTH = 200
GRAM = 32
SHARD_BYTES = 1 << 20
PARTS = 4
# As many stretches as fill a shard.
CROWD = SHARD_BYTES // (LENGTH + (LENGTH - GRAM) // PARTS)
# Contents or cores whose hashes may be broadcast, some 50 bytes each; more are joined by shuffle.
BROADCAST_CONTENTS = 500_000
# Bytes of text worked on at once.
SLAB = 1 << 20
# Hashed stretches handed on at once.
HASHED_ROWS = 1 << 16
# Hashes of a stretch; it holds the strings that start at first..last.
HASHED_NAMES = ["at", "first", "last", "core", "h1", "h2"]
HASHED_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
HASHED = "c1 bigint, c2 bigint, at int, first int, last int, core bigint, h1 bigint, h2 bigint"
# What goes to a shard, or to be compared by hashes (shard -1); ``ahead`` is from the first string to the anchor.
PIECE_NAMES = ["shard", "first", "piece", "ahead"]
PIECE_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.int32()]
PIECES = "c1 bigint, c2 bigint, shard int, first int, piece binary, ahead int"
ANCHORS = "c1 bigint, c2 bigint, at int, anchor bigint, around bigint"

_table = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, as many as were needed so far."""

    up = _powers(_BASE, 1)
    down = _powers(_BACK, 1)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(_BACK, n)


def _sliding(values: np.ndarray, width: int, best: np.ufunc, fill: int) -> np.ndarray:
    """The best of values[i : i + width] for each i, by running bests from both sides of blocks."""
    n = len(values)
    padded = np.full(-(-(n + width) // width) * width, fill, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, anchor hash, hash of the surroundings) of all anchors of the texts."""
    width = length - gram + 1
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(data)
    nothing = np.zeros(0, dtype=np.int64)
    if n < length:
        return nothing, nothing, nothing, nothing
    _Powers.reach(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_table[data] * _Powers.up[:n], out=total[1:])
    m = n - gram + 1
    hashes = _mixed((total[gram:] - total[:m]) * _Powers.down[:m])
    # Places from the start of a text to where its last whole string starts.
    whole = np.zeros(m + 1, dtype=np.int8)
    long = sizes >= length
    np.add.at(whole, (ends - sizes)[long], 1)
    np.add.at(whole, (ends - length + 1)[long], -1)
    valid = np.cumsum(whole[:m]).astype(bool)
    least = np.where(valid, _sliding(hashes, width, np.minimum, np.iinfo(np.uint64).max), np.uint64(0))
    # A gram is an anchor if it is the least of some whole string it is in.
    reached = _sliding(least[::-1], width, np.maximum, 0)[::-1]
    at = np.nonzero(reached == hashes)[0]
    owner = np.searchsorted(ends, at, side="right")
    start, end = ends[owner] - sizes[owner], ends[owner]
    inside = at + gram <= end
    at, owner, start, end = at[inside], owner[inside], start[inside], end[inside]
    low, high = np.maximum(start, at - (length - gram)), np.minimum(end, at + length)
    around = (total[high] - total[low]) * _Powers.down[low]
    around = _mixed(_mixed(around) + (at - low).astype(np.uint64) * np.uint64(1 << 32) + (high - low).astype(np.uint64))
    return owner, at - start, hashes[at].view(np.int64), around.view(np.int64)


def _slabs(texts: pa.Array, length: int) -> Iterator[list[tuple[int, int, bytes, int, int]]]:
    """(row, start, bytes, from, to) of texts, some SLAB bytes together.

    A text far longer than that is cut up; each part answers for the places from..to and has
    enough on both sides of them for all strings around.
    """
    own: list[tuple[int, int, bytes, int, int]] = []
    size = 0
    for row, value in enumerate(texts):
        text = value.as_py() or b""
        step = len(text) if len(text) <= 4 * SLAB else SLAB
        for low in range(0, len(text), step or 1):
            start, high = max(0, low - 2 * length), low + step
            part = text if step == len(text) else text[start : high + 2 * length]
            if own and size + len(part) > SLAB:
                yield own
                own, size = [], 0
            own.append((row, start, part, low, high))
            size += len(part)
    if own:
        yield own


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of following numbers as (first, last)."""
    if not len(starts):
        return []
    cut = np.nonzero(np.diff(starts) != 1)[0]
    firsts, lasts = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]
    return list(zip(firsts.tolist(), lasts.tolist(), strict=True))


def repeated_spans(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    crowd: int = CROWD,
    shard_bytes: int = SHARD_BYTES,
    broadcast_contents: int = BROADCAST_CONTENTS,
) -> DataFrame:
    """``c1, c2, spans``: for each content with repeats, where its repeated strings start (from, to).

    ``c1`` and ``c2`` are hashes of the text. Spans may overlap and are in no order.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    reach = length - gram
    texts = docs.select(
        *content(F.col(text)),
        F.col(text).cast("binary").alias("text"),
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-1)).alias("id"),
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in _slabs(batch.column(2), length):
                owner, at, anchor, around = anchors([part for _, _, part, _, _ in own], length, gram)
                row, start, low, high = (np.array([part[k] for part in own], dtype=np.int64) for k in (0, 1, 3, 4))
                at = at + start[owner]
                mine = (at >= low[owner]) & (at < high[owner])
                owner, at, anchor, around = owner[mine], at[mine], anchor[mine], around[mine]
                rows = pa.array(row[owner])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array(at.astype(np.int32)),
                        pa.array(anchor),
                        pa.array(around),
                    ],
                    ["c1", "c2", "at", "anchor", "around"],
                )

    path = work_path(spark, "anchors")
    texts.where(F.octet_length("text") >= length).select(*CONTENT, "text").mapInArrow(find, ANCHORS).write.parquet(path)
    all_anchors = spark.read.schema(ANCHORS).parquet(path)
    again = (
        all_anchors.groupBy("anchor")
        .agg(F.count("*").alias("times"), F.min("around").alias("lo"), F.max("around").alias("hi"))
        .where("times > 1")
        .select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"))
    )
    again_path = work_path(spark, "anchors-again")
    all_anchors.join(again, "anchor").write.parquet(again_path)
    remove(spark, path)
    met = spark.read.schema(ANCHORS + ", mixed boolean").parquet(again_path)
    around = F.struct(
        F.greatest(F.lit(0), F.col("at") - reach).alias("first"), F.col("at").alias("last")
    )
    same = met.where(~F.col("mixed")).select(*CONTENT, around.alias("span"))

    # One of each of the different surroundings, and whether it occurs again.
    mixed = met.where("mixed")
    kinds = (
        mixed.groupBy("anchor", "around")
        .agg(F.count("*").alias("times"), F.min(F.struct(*CONTENT, "at")).alias("one"))
        .checkpoint()
    )
    twice = (
        mixed.join(kinds.where("times > 1").select("anchor", "around"), ["anchor", "around"], "left_semi")
        .select(*CONTENT, around.alias("span"))
    )
    wanted = kinds.select("one.*").groupBy(*CONTENT).agg(F.collect_list("at").alias("asks")).checkpoint()
    held_path = work_path(spark, "texts")
    one_of_each(texts, wanted, broadcast_contents).write.parquet(held_path)
    held = spark.read.schema("c1 bigint, c2 bigint, text binary").parquet(held_path)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[np.ndarray] = []
            found: list[tuple[np.ndarray, ...]] = []
            size = 0
            for row in range(batch.num_rows):
                own = batch.column("text")[row].as_py()
                asks = batch.column("asks")[row].values.to_numpy().astype(np.int64)
                found.append(_stretches(own, asks, length, reach))
                rows.append(np.full(len(found[-1][0]), row))
                size += len(rows[-1])
                if size >= HASHED_ROWS or row == batch.num_rows - 1:
                    same_row = pa.array(np.concatenate(rows))
                    columns = (np.concatenate(c) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(c).take(same_row) for c in CONTENT),
                            *(pa.array(c, t) for c, t in zip(columns, HASHED_TYPES, strict=True)),
                        ],
                        [*CONTENT, *HASHED_NAMES],
                    )
                    rows, found, size = [], [], 0

    hashed_path = work_path(spark, "stretches")
    held.join(wanted, CONTENT).mapInArrow(hashed, HASHED).write.parquet(hashed_path)
    stretches = spark.read.schema(HASHED).parquet(hashed_path)
    piece = F.struct("h1", "h2")
    path = work_path(spark, "cores")
    (
        stretches.groupBy("core")
        .agg(F.count("*").alias("times"), F.min(piece).alias("lo"), F.max(piece).alias("hi"))
        .where("times > 1")
        .select("core", (F.col("lo") != F.col("hi")).alias("mixed"))
        .write.parquet(path)
    )
    cores = spark.read.schema("core bigint, mixed boolean").parquet(path)
    cores = F.broadcast(cores) if cores.count() <= broadcast_contents else cores
    path = work_path(spark, "stretches-again")
    stretches.join(cores, "core").write.parquet(path)
    remove(spark, hashed_path)
    alive = spark.read.schema(HASHED + ", mixed boolean").parquet(path)
    same_piece = ["core", "h1", "h2"]
    groups = (
        alive.groupBy(*same_piece, "mixed")
        .agg(F.count("*").alias("times"), F.min(F.struct(*CONTENT, "at", "first", "last")).alias("one"))
        .checkpoint()
    )
    whole = (
        alive.join(groups.where("times > 1").select(*same_piece), same_piece, "left_semi")
        .select(*CONTENT, F.struct("first", "last").alias("span"))
    )
    # Of different stretches of a core one each is left; crowded cores are at most 1 / CROWD of these.
    crowded = (
        groups.where("mixed").groupBy("core").agg(F.count("*").alias("pieces")).where(F.col("pieces") > crowd)
    ).select("core", F.lit(True).alias("crowded")).checkpoint()
    crowded = F.broadcast(crowded) if crowded.count() <= broadcast_contents else crowded
    ones = groups.where("mixed").join(crowded, "core", "left")
    total = groups.where("mixed").count() * (length + reach // PARTS)
    shards = max(1, -(-total // shard_bytes))
    shard = F.when(F.col("crowded"), -1).otherwise(F.pmod("core", F.lit(shards)).cast("int")).alias("shard")
    asked = (
        ones.select("one.*", shard)
        .groupBy(*CONTENT)
        .agg(F.collect_list(F.struct("at", "first", "last", "shard")).alias("asks"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.column("text")[row].as_py()
                asks = batch.column("asks")[row].values.flatten()
                at, first, last, shard = (c.to_numpy().astype(np.int64) for c in asks)
                few = shard >= 0
                out = [
                    (-1, a, own[a : b + length], k - a)
                    for k, a, b in zip(at[~few].tolist(), first[~few].tolist(), last[~few].tolist(), strict=True)
                ]
                out += [(k, a, own[a : b + length], 0) for k, a, b in _merged(shard[few], first[few], last[few])]
                yield _rows(batch, row, out, PIECE_NAMES, PIECE_TYPES)

    # Read twice, by shards and by strings.
    path = work_path(spark, "pieces")
    held.join(asked, CONTENT).mapInArrow(cut, PIECES).write.parquet(path)
    remove(spark, held_path)
    sent = spark.read.schema(PIECES).parquet(path)

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        firsts = rows["first"].to_numpy()
        out = []
        for k, starts in enumerate(repeated_starts(rows["piece"].to_pylist(), length)):
            out += [(k, a, b) for a, b in _spans(starts + int(firsts[k]))]
        owners = pa.array([k for k, _, _ in out], pa.int64())
        span = pa.StructArray.from_arrays(
            [pa.array([a for _, a, _ in out], pa.int32()), pa.array([b for _, _, b in out], pa.int32())],
            ["first", "last"],
        )
        return pa.table({"c1": rows["c1"].take(owners), "c2": rows["c2"].take(owners), "span": span})

    shard_spans = (
        sent.where("shard >= 0")
        .drop("ahead")
        .groupBy("shard")
        .applyInArrow(compare, "c1 bigint, c2 bigint, span struct<first:int,last:int>")
    )
    single_spans = _one_by_one(sent.where("shard = -1"), length)
    spans = same.unionByName(twice).unionByName(whole).unionByName(shard_spans).unionByName(single_spans)
    return spans.groupBy(*CONTENT).agg(F.collect_set("span").alias("spans"))


def _signed(h: int) -> tuple[int, int]:
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _rows(batch: pa.RecordBatch, row: int, out: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    """What was made of one row, with the hashes of its text."""
    same_row = pa.array(np.full(len(out), row))
    columns = zip(*out, strict=True) if out else [()] * len(types)
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c).take(same_row) for c in CONTENT), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
        [*CONTENT, *names],
    )


def _stretches(own: bytes, anchors: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, ...]:
    """The strings around anchors in stretches at fixed distances from them, with the hashes that tell them apart."""
    step = -(-(reach + 1) // PARTS)
    lows = np.arange(0, reach + 1, step)
    at, low = np.repeat(anchors, len(lows)), np.tile(lows, len(anchors))
    high = np.minimum(reach, low + step - 1)
    first, last = np.maximum(0, at - high), np.minimum(len(own) - length, at - low)
    some = first <= last
    at, low, high, first, last = at[some], low[some], high[some], first[some], last[some]
    # What all strings of a stretch have, and what any of them has; the distance is part of both hashes.
    cores = zip((at - low).tolist(), (at - high + length).tolist(), low.tolist(), strict=True)
    pieces = zip(first.tolist(), (last + length).tolist(), (at - first).tolist(), strict=True)
    core = np.frombuffer(b"".join([xxhash.xxh3_64_digest(own[a:b], seed) for a, b, seed in cores]), ">i8")
    whole = np.frombuffer(b"".join([xxhash.xxh3_128_digest(own[a:b], seed) for a, b, seed in pieces]), ">i8")
    return at, first, last, core.astype(np.int64), whole[::2].astype(np.int64), whole[1::2].astype(np.int64)


def _merged(shard: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, first, last) of one text's stretches, with those that overlap and go the same way as one."""
    if not len(shard):
        return []
    order = np.lexsort((first, shard))
    shard, first, last = shard[order], first[order], last[order]
    base = shard << 32
    reached = np.maximum.accumulate(base + last)
    apart = base[1:] + first[1:] > reached[:-1] + 1
    begins, ends = np.concatenate(([True], apart)), np.concatenate((apart, [True]))
    return list(zip(shard[begins].tolist(), first[begins].tolist(), (reached - base)[ends].tolist(), strict=True))


def _one_by_one(pieces: DataFrame, length: int) -> DataFrame:
    """``c1, c2, span`` of the strings that occur again among the strings of pieces."""

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, ahead = batch.column("first").to_pylist(), batch.column("ahead").to_pylist()
            for row, piece in enumerate(batch.column("piece")):
                own = piece.as_py()
                out = [
                    (firsts[row] + k, *_signed(xxhash.xxh3_128_intdigest(own[k : k + length], ahead[row] - k)))
                    for k in range(len(own) - length + 1)
                ]
                yield _rows(batch, row, out, ["first", "h1", "h2"], [pa.int32(), pa.int64(), pa.int64()])

    strings = pieces.select(*CONTENT, "piece", "first", "ahead").mapInArrow(
        take_apart, "c1 bigint, c2 bigint, first int, h1 bigint, h2 bigint"
    )
    repeats = strings.groupBy("h1", "h2").agg(F.count("*").alias("times")).where("times > 1").select("h1", "h2")
    span = F.struct("first", F.col("first").alias("last")).alias("span")
    return strings.join(repeats, ["h1", "h2"], "left_semi").select(*CONTENT, span)


def covered(spans: pa.ListScalar, size: int, length: int) -> np.ndarray:
    """Which bytes of a text of ``size`` bytes are in a string that starts in one of the spans."""
    mark = np.zeros(size + 1, dtype=np.int32)
    if spans is not None and spans.is_valid:
        first, last = (c.to_numpy().astype(np.int64) for c in spans.values.flatten())
        last = np.minimum(last, size - length)
        first, last = first[last >= first], last[last >= first]
        np.add.at(mark, first, 1)
        np.add.at(mark, last + length, -1)
    return np.cumsum(mark[:-1]) > 0


def dedup_substrings(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, with_kept: bool = False, **settings
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the bytes left), one row per row of ``docs``.

    Texts are UTF-8 bytes; null and empty ones have none. A byte goes if a string of
    ``length`` bytes over it also starts somewhere else, in the same text or in another
    row, overlaps counted and judged on the input. Rows that repeat are texts like any others, so
    all of them lose what is long enough. Other columns are ignored; a null id stays null;
    an empty table gives no rows.
    """
    spans = repeated_spans(docs, doc_id, text, length, **settings)
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        *content(F.col(text)),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    ).join(spans, CONTENT, "left").select("doc_id", "text", "spans")
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]
    schema = pa.schema([*fields, ("kept_sha256", pa.string()), *([("kept", pa.binary())] * with_kept)])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for own_id, value, spans in zip(*(batch.column(k) for k in range(3)), strict=True):
                own = value.as_py()
                gone = covered(spans, len(own), length)
                kept = np.frombuffer(own, dtype=np.uint8)[~gone].tobytes() if gone.any() else own
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                row = (own_id.as_py(), len(own), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if with_kept else row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema
            )

    kept = ", kept binary" if with_kept else ""
    return rows.mapInArrow(
        remove, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{kept}"
    )
