"""SimHash near duplicates, with pigeonring filtering before the full Hamming check.

A fingerprint has 64 bits; two link at ``LIMIT`` = 2 or fewer differing bits. The
bits are cut into a ring of three segments. If at most 2 bits differ in all,
there is a segment from which on every chain of l consecutive segments has at
most 2 l / 3 differing bits: none in the first, one in the first two, two in all
three. So fingerprints meet only where a whole segment is equal, and a pair goes
on only if the next segment keeps within its share; then all bits are compared.

A segment value that more than ``CROWD`` different fingerprints share is not
paired out, as pairs would grow with the square of the crowd. Its fingerprints
are linked exactly in another way: each is written to itself and to every
fingerprint one bit away that has the same segment. Two differ in at most 2 bits
if and only if they meet somewhere there, and all that meet at one place are within
2 bits of each other, so linking each to the smallest one loses no connection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platenlog.llm.components import components
from platenlog.plans.session import shared_folder

WORDS = 3
SEED = 42
LIMIT = 2
# (lowest bit, bits) of the ring's segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
CROWD = 64
CHUNK = 1 << 16
# Rows that go, or repeat, are looked up by a broadcast of so many ids and hashes, 18 bytes each.
SENT = 500_000


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The signed 64-bit fingerprint of a whole text in UTF-8; 0 without words."""
    # bytes.lower and bytes.split know A-Z and the six ASCII blanks only.
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False))
    digest, seen = xxhash.xxh64_digest, 0
    ones = np.zeros(64, dtype=np.int64)
    chunk: list[bytes] = []

    def add() -> None:
        bits = np.unpackbits(np.frombuffer(b"".join(chunk), dtype=np.uint8).reshape(-1, 8), axis=1)
        ones[:] += bits.sum(axis=0, dtype=np.int64)

    for shingle in shingles:
        chunk.append(digest(shingle, SEED))
        seen += 1
        if len(chunk) == CHUNK:
            add()
            chunk.clear()
    if chunk:
        add()
    return int(np.packbits(ones * 2 > seen).view(">i8")[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """The signed fingerprint of shingles by their signed 64-bit hashes; 0 without any."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), CHUNK):
        octets = hashes[k : k + CHUNK].astype(">i8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, content, fp`` for every row: the id, a hash of the text, the fingerprint.

    Shingles of ``words`` words, repeats counted, A-Z lower-cased; fewer words make
    one shingle, and a null, empty or blank text has fingerprint 0.
    """
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.xxhash64(text).alias("content"),
        F.col(text).cast("binary").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(t.as_py(), words) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], ["doc_id", "content", "fp"])

    return rows.mapInArrow(run, "doc_id bigint, content bigint, fp bigint")


def _segment(fp: Column, k: int) -> Column:
    low, bits = SEGMENTS[k]
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``a, b``: links between different fingerprints (``fp``, distinct) that connect all within 2 bits.

    Pairs from uncrowded segment values are complete; crowded ones give a star
    for each meeting place. Every link is within 2 bits.
    """
    shared_folder(fps.sparkSession)
    fp = F.col("fp")
    keys = fps.select(
        "fp",
        F.inline(
            F.array(*[F.struct(F.lit(k).alias("k"), _segment(fp, k).alias("part")) for k in range(len(SEGMENTS))])
        ),
    )
    met = keys.groupBy("k", "part").agg(F.count("*").alias("n")).where("n > 1")
    keys = keys.join(met, ["k", "part"]).checkpoint()
    few, crowded = keys.where(F.col("n") <= crowd), keys.where(F.col("n") > crowd)

    differ = F.col("a").bitwiseXOR(F.col("b"))
    budget = [LIMIT * chain // len(SEGMENTS) for chain in range(1, len(SEGMENTS) + 1)]
    within = F.lit(False)
    for k in range(len(SEGMENTS)):
        # The chain that starts at segment k: first equal by the join, then longer chains.
        mask, chain = 0, F.lit(True)
        for length in range(1, len(SEGMENTS) + 1):
            low, bits = SEGMENTS[(k + length - 1) % len(SEGMENTS)]
            mask |= ((1 << bits) - 1) << low
            if length > 1:
                chain = chain & (F.bit_count(differ.bitwiseAND(F.lit(_signed(mask)))) <= budget[length - 1])
        within = within | ((F.col("k") == k) & chain)
    pairs = (
        few.select("k", "part", F.col("fp").alias("a"))
        .join(few.select("k", "part", F.col("fp").alias("b")), ["k", "part"])
        .where((F.col("a") < F.col("b")) & within & (F.bit_count(differ) <= LIMIT))
        .select("a", "b")
    )

    # Itself, and one bit away outside the segment that is equal anyway.
    places = F.lit(None)
    for k, (low, bits) in enumerate(SEGMENTS):
        flips = [0, *(_signed(1 << b) for b in range(64) if not low <= b < low + bits)]
        places = F.when(F.col("k") == k, F.transform(F.array(*map(F.lit, flips)), lambda f: fp.bitwiseXOR(f))).otherwise(
            places
        )
    around = crowded.select("fp", F.explode(places).alias("place")).distinct()
    heads = around.groupBy("place").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = (
        around.join(heads, "place")
        .select("a", F.col("fp").alias("b"))
        .where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= LIMIT))
    )
    return pairs.unionByName(stars).distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, crowd: int = CROWD
) -> DataFrame:
    """``doc_id, content, fp, root, component_id``, one row per row of ``docs``.

    ``root`` is the smallest fingerprint that links lead to and tells components apart.
    ``component_id`` is the smallest id that links lead to, its own included. A
    null id never is a component's id unless the component has no other. Rows
    that repeat are rows of the same component; other columns are ignored; an
    empty table gives no rows. Texts are read once; all else runs on ids and
    fingerprints, equal texts being one fingerprint from the start.
    """
    shared_folder(docs.sparkSession)
    rows = fingerprints(docs, doc_id, text, words).checkpoint()
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    joined = components(links(classes.select("fp"), crowd))
    rooted = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(heads, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "content", "fp", "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: one row of each component.

    The row with the component's smallest id stays; among rows of that id, one by
    the hash of its text. Exact repeats of a row count as one.
    """
    return one_of_each_root(docs, near_duplicates(docs, doc_id, text, words), doc_id, text)


def one_of_each_root(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` without those that ``found`` (``doc_id, content, root, component_id`` for each) has a smaller one for.

    Which rows go is settled on ids and hashes. Where few go they are sent out and no text is moved; else
    every text is moved once.
    """
    pairs = found.groupBy("doc_id", "content").agg(
        F.count("*").alias("n"), F.min("root").alias("root"), F.min("component_id").alias("component_id")
    )
    winners = (
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min("content").alias("__least"))
    )
    own, stays = F.col("doc_id"), F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("content") == F.col("__least"))
    # Those that go, and those that stay but are there more than once.
    named = (
        pairs.join(winners, "root")
        .where(~stays | (F.col("n") > 1))
        .select(
            F.coalesce(own, F.lit(0)).alias("__own"), own.isNull().alias("__none"), F.col("content").alias("__hash"), stays.alias("__stays")
        )
        .checkpoint()
    )
    size = named.agg(F.count("*").alias("n"), F.count_if("__stays").alias("again")).first()
    place = ["__own", "__none", "__hash"]
    first = W.partitionBy(*place).orderBy(F.lit(0))
    columns = [F.col(f"`{name}`") for name in docs.columns]
    ids = F.col(f"`{doc_id}`").cast("bigint")
    keyed = docs.withColumns({"__own": F.coalesce(ids, F.lit(0)), "__none": ids.isNull(), "__hash": F.xxhash64(text)})
    if size["n"] > SENT:
        # The join has dealt the rows as the window wants them.
        kept = keyed.join(named, place, "left").where(F.coalesce("__stays", F.lit(True)))
        return kept.withColumn("__place", F.row_number().over(first)).where("__place = 1").select(columns)
    marked = keyed.join(F.broadcast(named), place, "left")
    alone = marked.where("__stays is null").select(columns)
    if not size["again"]:
        return alone
    again = marked.where("__stays").withColumn("__place", F.row_number().over(first)).where("__place = 1")
    return alone.unionByName(again.select(columns))
