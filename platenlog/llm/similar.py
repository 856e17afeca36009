"""Near copies by SimHash with pigeonring filtering, completed by prefixes; every link verified by exact similarity.

Two texts link if their sets of word shingles have a Jaccard similarity of ``threshold``
or more. Candidates come first from fingerprints of the sets: those that ``simhash.links`` connects by its ring of
segments. A threshold bounds no number of bits, so similar sets may be further apart, and these are found exactly by
prefixes. The shingles of a set are put in one order that holds for all texts; sets that
similar then share one of their first n - ceil(threshold n) + 1, so texts meet on those
alone and no pair is missed. The order is by hash, but shingles that very many prefixes
hold come last: which ones those are is a matter of speed, not of the result.

A pair that meets is tried on its sizes, then on counts: a set's shingles are dealt to slots, at most
eight of them to a slot on average, and sets share no more than the smaller counts add up to.
What is left is settled by the sets themselves.

Every shingle's members are first tried with one of them, its head: copies of one text are
then joined by one comparison each and not by one for each pair. A pair needs no
comparison once it is in one component. Others are compared pair by pair, but where more than ``CROWD`` rows share a shingle: there a few members are pivots, compared with
all members that are not yet in their component; then the components are made again, and so on with
more pivots, or with all that are left once that is little. This ends with the components that all pairs would give.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platenlog.llm import simhash
from platenlog.llm.components import components, dealt
from platenlog.llm.simhash import SEED, one_of_each_root
from platenlog.plans.session import shared_folder, work_path
from platenlog.sources import folders

WORDS = 5
THRESHOLD = 0.8
CROWD = 64
# Shingles that may be put last, 8 bytes each on every executor.
LAST = 200_000
# Pivots of a shingle at first, and so many times more from round to round.
PIVOTS = 8
MORE = 64
# Slots of a set's counts: from so many, doubled while the set has more than eight shingles for each.
SLOTS = 64
# Copies of texts that are looked up by a broadcast of their hashes and ids, 16 bytes each.
SENT = 500_000
# One in so many texts is asked which shingles are common.
ASKED = 16
# Documents that a task is worth: their keys, pairs and links are read again in no more partitions than that makes.
DOCS_A_TASK = 2_000


def marks(text: bytes | None, words: int) -> np.ndarray:
    """The sorted hashes of a whole text's different shingles; one shingle for fewer words, none without."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.int64)
    width = min(words, len(tokens))
    shingles = map(b" ".join, zip(*(tokens[k:] for k in range(width)), strict=False))
    digest = xxhash.xxh64_digest
    own = np.sort(np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), dtype=">i8").astype(np.int64))
    return own[np.concatenate(([True], own[1:] != own[:-1]))]


def node(own: np.ndarray) -> int:
    """A hash of a set, so that equal sets are one node; 0 for the empty one."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)))) if len(own) else 0


def prefix(own: np.ndarray, last: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The shingles a set is found by: those of the usual order, and those of ``last`` that are needed after them."""
    most = len(own) - ceil(threshold * len(own) - 1e-9) + 1 if len(own) else 0
    if len(last) and len(own):
        at = np.minimum(np.searchsorted(last, own), len(last) - 1)
        late = last[at] == own
        early = own[~late][:most]
        return early, own[late][: most - len(early)]
    return own[:most], own[:0]


def counts(own: np.ndarray) -> bytes:
    """How many shingles are in each slot, up to 255; a slot is the low bits of the hash."""
    slots = SLOTS
    while 8 * slots < len(own):
        slots *= 2
    return np.minimum(np.bincount(own & (slots - 1), minlength=slots), 255).astype(np.uint8).tobytes()


def most_shared(a: bytes, b: bytes) -> int:
    """At most so many shingles are in both sets; counts of the larger set are folded to the slots of the smaller."""
    few, many = sorted((np.frombuffer(c, np.uint8).astype(np.int64) for c in (a, b)), key=len)
    folded = many.reshape(-1, len(few)).sum(axis=0)
    # A full slot may hold more than it shows.
    full = (many.reshape(-1, len(few)) == 255).any(axis=0) | (few == 255)
    return int(np.minimum(few, folded)[~full].sum()) + (1 << 40) * bool(full.any())


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.xxhash64(text).alias("content"),
        F.col(text).cast("binary").alias("text"),
    )


SKETCHES = "doc_id bigint, content bigint, node bigint, fp bigint, n int, bits binary, prefix array<bigint>, late array<bigint>"


def sketches(texts: DataFrame, words: int, threshold: float, last: list[int]) -> DataFrame:
    """``doc_id, content, node, fp, n, bits, prefix, late`` for every row; ``fp`` is the SimHash of the set."""
    shared = texts.sparkSession.sparkContext.broadcast(np.array(sorted(last), dtype=np.int64))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for value in batch.column(2):
                own = marks(value.as_py(), words)
                made.append((node(own), simhash.fingerprint_of(own), len(own), counts(own), *prefix(own, shared.value, threshold)))
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns], ["doc_id", "content", "node", "fp", "n", "bits", "prefix", "late"]
            )

    return texts.mapInArrow(run, SKETCHES)


def common(texts: DataFrame, words: int, crowd: int) -> list[int]:
    """Shingles that very many texts hold, as far as a part of the texts shows: at most ``LAST``."""
    part = texts.where(F.pmod("content", F.lit(ASKED)) == 0)
    # At threshold 0 a prefix is the whole set.
    seen = sketches(part, words, 0.0, []).select(F.explode("prefix").alias("key")).groupBy("key").count()
    often = seen.where(F.col("count") * ASKED > crowd).where("count > 1")
    return [r.key for r in often.orderBy(F.desc("count"), "key").limit(LAST).collect()]


def met_keys(rows: DataFrame, tasks: int) -> DataFrame:
    """``key, node, n, rows`` where different nodes share a key; the common ones have no ``rows``."""
    # Window sorts are even, as common keys are not in them.
    place = W.partitionBy("key")
    early = rows.select(F.explode("prefix").alias("key"), "node", "n").select(
        "key", "node", "n", F.min("node").over(place).alias("lo"), F.max("node").over(place).alias("hi"), F.count("*").over(place).alias("rows")
    )
    early = dealt(early.where("lo < hi").select("key", "node", "n", "rows"), tasks).distinct()
    late = rows.select(F.explode("late").alias("key"), "node", "n").distinct()
    shared = late.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    late = late.join(shared, "key", "left_semi").select("key", "node", "n", F.lit(None).cast("bigint").alias("rows"))
    return dealt(early.unionByName(late), tasks).checkpoint()


def sets_of(texts: DataFrame, rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node, marks`` of the nodes in ``wanted``, once each, from one copy of a text each."""
    first = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("content").alias("__content"), F.min_by("doc_id", "content").alias("__id"))
    # Only the rows that are read for their sets are moved, and none where the hashes fit a broadcast.
    first = first.select("__content", "__id").checkpoint()
    if first.count() <= SENT:
        first = F.broadcast(first)
    chosen = texts.join(
        first, (F.col("content") == F.col("__content")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi"
    ).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [marks(value.as_py(), words) for value in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([node(m) for m in made], pa.int64()), pa.array(made, pa.list_(pa.int64()))], ["node", "marks"]
            )

    # Rows that repeat with their id.
    return chosen.mapInArrow(run, "node bigint, marks array<bigint>").groupBy("node").agg(F.first("marks").alias("marks"))


def ring_pairs(rows: DataFrame, crowd: int) -> DataFrame:
    """``a, b``, the smaller first: nodes whose fingerprints the pigeonring links, and those of one fingerprint with one of them."""
    known = rows.where("n > 0").select("fp", "node").distinct()
    heads = known.groupBy("fp").agg(F.min("node").alias("head")).checkpoint()
    alike = known.join(heads, "fp").select(F.col("head").alias("a"), F.col("node").alias("b"))
    near = (
        simhash.links(heads.select("fp"), crowd)
        .toDF("fa", "fb")
        .join(heads.toDF("fa", "ha"), "fa")
        .join(heads.toDF("fb", "hb"), "fb")
        .select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    )
    return alike.where("a < b").unionByName(near)


def joined_nodes(texts: DataFrame, rows: DataFrame, words: int, threshold: float, crowd: int, tasks: int) -> DataFrame | None:
    """``node, root``: the components that verified links of all similar pairs would give; None if nothing meets."""
    spark = texts.sparkSession
    keys = met_keys(rows, tasks)
    if keys.isEmpty():
        return None
    few = keys.where(F.col("rows") <= crowd)
    crowded = keys.where(F.col("rows").isNull() | (F.col("rows") > crowd)).select("key", "node", "n")
    sizes = rows.join(keys.select("node").distinct(), "node", "left_semi").select("node", "n", "bits")
    sizes = dealt(dealt(sizes, tasks).distinct(), tasks).checkpoint()

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, total = (batch.column(k).to_pylist() for k in (2, 3, 4))
            # Sets that are similar enough share at least this part of their sizes.
            least = threshold / (1 + threshold)
            kept = [most_shared(a, b) >= least * n - 1e-6 for a, b, n in zip(left, right, total, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(
                pa.array(kept, pa.bool_())
            )

    # Before pairs are moved, so that those of unlike sizes never are.
    near = F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-6

    def verified(pairs: DataFrame) -> DataFrame:
        sized = dealt(dealt(pairs, tasks).join(sizes.toDF("a", "na", "ba"), "a"), tasks)
        sized = dealt(sized.join(sizes.toDF("b", "nb", "bb"), "b").where(near), tasks)
        left = sized.select("a", "b", "ba", "bb", (F.col("na") + F.col("nb")).cast("bigint").alias("total"))
        left = left.mapInArrow(maybe, "a bigint, b bigint").checkpoint()
        wanted = dealt(left.select(F.col("a").alias("node")).union(left.select("b")).distinct(), tasks)
        path = work_path(spark, "sets")
        dealt(sets_of(texts, rows, wanted, words), tasks).write.parquet(path)
        sets = spark.read.schema("node bigint, marks array<bigint>").parquet(path)
        both = dealt(dealt(left.join(sets.toDF("a", "ma"), "a"), tasks).join(sets.toDF("b", "mb"), "b"), tasks)
        shared = F.size(F.array_intersect("ma", "mb"))
        union = F.size("ma") + F.size("mb") - shared
        linked = both.where(shared >= F.lit(threshold) * union - 1e-9).select("a", "b").checkpoint()
        folders.remove(spark, path)
        return linked

    # What the fingerprints find, and everybody with the head of the shingle; those with the same head are joined, which is all that is asked here.
    members = keys.select("key", F.col("node").alias("b"), F.col("n").alias("nb"))
    heads = members.groupBy("key").agg(F.min("b").alias("a"), F.min_by("nb", "b").alias("na"))
    met = dealt(members.join(heads, "key").where("a < b").where(near).select("a", "b"), tasks)
    found = verified(dealt(ring_pairs(rows, crowd), tasks).unionByName(met).distinct())
    # Whole components, so that a crowd of near copies has nothing left to ask.
    joined = components(found, tasks).checkpoint()
    # Where members are few, all pairs that this has not joined.
    own = few.select("key", "node", "n").join(joined, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    apart = own.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    own = own.join(apart, "key", "left_semi").checkpoint()
    pairs = own.toDF("key", "a", "na", "ra").join(own.toDF("key", "b", "nb", "rb"), "key").where("a < b and ra != rb").where(near).select("a", "b")
    pairs = dealt(pairs, tasks)
    todo = crowded.withColumn("done", F.lit(False))
    step = 0
    while True:
        placed = todo.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
        parts = placed.groupBy("key", "root").agg(F.count("*").alias("size"))
        largest = parts.groupBy("key").agg(F.max_by("root", "size").alias("largest"))
        # Members of one component need each other no more.
        placed = placed.join(largest, "key").withColumn("open", ~F.col("done") & (F.col("root") != F.col("largest"))).checkpoint()
        turn = F.xxhash64("node", F.lit(step))
        sums = placed.groupBy("key").agg(F.count("*").alias("m"), F.count_if("open").alias("o"))
        total = sums.agg(F.sum("m").alias("m"), F.sum("o").alias("o"), F.sum(F.col("m") * F.col("o")).alias("pairs")).first()
        if step and not total["o"]:
            return joined
        # All at once where that is no more for a row than in a crowd of ``crowd``.
        whole = (total["pairs"] or 0) <= crowd * (total["m"] or 0)
        if whole:
            pivots = placed.where("open").select("key", F.col("node").alias("pivot"), F.col("n").alias("nb"), F.col("root").alias("own"))
        else:
            pivots = dealt(
                placed.where("open")
                .groupBy("key", F.pmod(turn, F.lit(PIVOTS * MORE**step)).alias("slot"))
                .agg(F.min_by("node", turn).alias("pivot"), F.min_by("n", turn).alias("nb"), F.min_by("root", turn).alias("own"))
                .drop("slot"),
                tasks,
            ).checkpoint()
        asked = dealt(
            placed.withColumnRenamed("n", "na").join(pivots, "key")
            .where(F.col("root") != F.col("own"))
            .where(near)
            .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")),
            tasks,
        )
        pairs = asked if step else asked.unionByName(pairs)
        fresh = verified(pairs.distinct())
        # The components stand for the links that made them.
        if not fresh.isEmpty():
            joined = components(joined.toDF("a", "b").unionByName(fresh), tasks).checkpoint()
        # Once all outside of a largest component are asked, no pair of different components is left, whichever is the largest then.
        if whole or pivots.count() == total["o"]:
            return joined
        todo = dealt(
            placed.join(pivots.select("key", F.col("pivot").alias("node"), F.lit(True).alias("was")), ["key", "node"], "left")
            .select("key", "node", "n", (F.col("done") | F.col("was").isNotNull()).alias("done")),
            tasks,
        ).checkpoint()
        step += 1


def near_copies(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    crowd: int = CROWD,
) -> DataFrame:
    """``doc_id, content, root, component_id``, one row per row of ``docs``.

    Shingles of ``words`` words, A-Z lower-cased, each counted once; fewer words make one
    shingle, and texts without words are copies of each other. ``root`` tells components
    apart; ``component_id`` is the smallest id that links lead to, null only if there is no other.
    Repeated rows are rows of the same component; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    texts = _texts(docs, doc_id, text)
    last = common(texts, words, crowd)
    path = work_path(spark, "sketches")
    sketches(texts, words, threshold, last).write.parquet(path)
    rows = spark.read.schema(SKETCHES).parquet(path)
    tasks = max(1, -(-rows.count() // DOCS_A_TASK))
    joined = joined_nodes(texts, rows, words, threshold, crowd, tasks)
    own = rows.select("doc_id", "content", "node")
    if joined is None:
        named = own.withColumnRenamed("node", "root")
    else:
        named = own.join(joined, "node", "left").select(
            "doc_id", "content", F.coalesce("root", "node").alias("root")
        )
    named = dealt(named, tasks).checkpoint()
    heads = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(heads, "root").select("doc_id", "content", "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each component the row with the smallest id.

    Among rows of that id one stays by the hash of its text; exact repeats of a row count as one.
    """
    return one_of_each_root(docs, near_copies(docs, doc_id, text, **settings), doc_id, text)
