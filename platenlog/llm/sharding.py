"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``nodes`` points on a ring of 2**32 positions; a document stands
where the hash of its text falls and belongs to the next point clockwise, so
equal texts stand together. No shard may hold more than (1 + ``slack``) times the
mean number of bytes: what overflows a full shard continues clockwise to the
next one with room. Only what overflows moves away from its point.

The stretches between points ("arcs") are a table of fixed size. The walk round
the ring works on their byte totals alone; the documents are placed by their
running byte count inside their arc. Arcs are cut into blocks by stretches of the text
hash, and a text that alone exceeds a block by a hash of the row, so that an arc that
holds a third of all rows is still many tasks, and copies are next to each other in it:
where an arc is cut, at most the group that the cut falls in is parted.
"""

from __future__ import annotations

from fractions import Fraction

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platenlog.plans.session import shared_folder

NODES = 64
SLACK = Fraction(1, 1000)
RING = 1 << 32
CELLS = 4096
BLOCK_ROWS = (256, 100_000)


def ring_points(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(position, shard) in ring order; a shard's points depend on its number alone."""
    return sorted(
        (xxhash.xxh64_intdigest(f"shard {shard} node {node}") % RING, shard)
        for shard in range(shards)
        for node in range(nodes)
    )


def walk_ring(sizes: list[int], owners: list[int], shards: int, slack: Fraction = SLACK) -> list[tuple[int, int, int]]:
    """(arc, byte from which on, shard): where each part of each arc goes.

    ``sizes`` are the bytes of the arcs in ring order and ``owners`` the shards of
    the points that end them. Arcs fill their own shard first, in ring order; the
    rest of each then goes clockwise to the shards that still have room.
    """
    limit = -(-sum(sizes) * (1 + slack) // shards)
    room = [int(limit)] * shards
    pieces: list[tuple[int, int, int]] = []
    over: list[tuple[int, int]] = []
    for arc, (size, shard) in enumerate(zip(sizes, owners, strict=True)):
        taken = min(size, room[shard])
        room[shard] -= taken
        if taken or not size:
            pieces.append((arc, 0, shard))
        if taken < size:
            over.append((arc, taken))
    for arc, at in over:
        step = arc
        while at < sizes[arc]:
            step += 1
            shard = owners[step % len(owners)]
            taken = min(sizes[arc] - at, room[shard])
            if taken:
                room[shard] -= taken
                pieces.append((arc, at, shard))
                at += taken
    return pieces


def shard_documents(
    docs: DataFrame,
    shards: int,
    doc_id: str = "doc_id",
    text: str = "text",
    nodes: int = NODES,
    slack: Fraction = SLACK,
    block_rows: tuple[int, int] = BLOCK_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the UTF-8 length of the text and 16 more; ``slot`` numbers the rows
    of a shard from 0 without gaps. A shard holds at most (1 + ``slack``) times
    the mean bytes, up to one document at each place where an arc is cut. A null
    text counts as empty, a null id is hashed like any value, repeated rows are
    placed one by one in no particular order among themselves, other columns are
    ignored, and an empty table gives no rows.

    The texts are read once: rows of numbers are checkpointed, and the rest runs on
    those. To the driver go the arc totals, at most ``shards * nodes`` rows.
    """
    spark = docs.sparkSession
    points = ring_points(shards, nodes)
    places, owners = [p for p, _ in points], [s for _, s in points]
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        (F.octet_length(content) + 16).cast("bigint").alias("size"),
        F.crc32(F.encode(content, "UTF-8")).cast("bigint").alias("text_crc32"),
        F.pmod(F.xxhash64(content), F.lit(RING)).alias("place"),
        F.xxhash64(content).alias("own"),
        F.xxhash64(F.col(doc_id), content).alias("mark"),
    )
    # The ring in equal cells, each with the points before it and those inside: CELLS rows.
    width = RING // CELLS
    cells = spark.createDataFrame(
        [
            (c, sum(p < c * width for p in places), [p for p in places if p // width == c])
            for c in range(CELLS)
        ],
        "cell bigint, passed int, inside array<bigint>",
    )
    # The first point at or after the place; past the last one, the first again.
    arc = F.col("passed") + F.size(F.filter("inside", lambda p: p < F.col("place")))
    shared_folder(spark)
    rows = (
        rows.withColumn("cell", F.floor(F.col("place") / width))
        .join(F.broadcast(cells), "cell")
        .withColumn("arc", F.pmod(arc, F.lit(len(points))))
        .drop("cell", "passed", "inside")
        .checkpoint()
    )
    totals = {r.arc: r for r in rows.groupBy("arc").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    sizes = [totals[a].b if a in totals else 0 for a in range(len(points))]
    n_rows = sum(r.n for r in totals.values())
    each = min(max(n_rows // 4096, block_rows[0]), block_rows[1])
    parts: dict[int, list[tuple[int, int]]] = {}
    for a, start, shard in walk_ring(sizes, owners, shards, slack):
        parts.setdefault(a, []).append((start, shard))
    # One row per arc: bounded by shards * nodes, however large the data. The first arc runs over the ring's end.
    spans = [(places[a - 1], (places[a] - places[a - 1]) % RING or RING) for a in range(len(points))]
    arcs = spark.createDataFrame(
        [
            (a, -(-totals[a].n // each), *spans[a], [s for s, _ in sorted(parts[a])], [x for _, x in sorted(parts[a])])
            for a in totals
        ],
        "arc int, blocks bigint, after bigint, span bigint, starts array<bigint>, shards array<int>",
    )
    keyed = rows.join(F.broadcast(arcs), "arc").withColumn(
        "block", F.expr("pmod(place - after - 1, %d) * blocks div span" % RING)
    )
    # Texts that alone exceed a block: no more than there are blocks of rows.
    hot = (
        keyed.groupBy("arc", "block", "place", "own")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > each)
        .groupBy("arc", "block")
        .agg(F.collect_list(F.struct("place", "own", F.ceil(F.col("n") / each).alias("salts"))).alias("hot"))
    )
    text_place = F.struct("place", "own")
    earlier_hot = F.size(F.filter("hot", lambda h: F.struct(h["place"], h["own"]) < text_place))
    salts = F.filter("hot", lambda h: (h["place"] == F.col("place")) & (h["own"] == F.col("own")))
    is_hot = F.coalesce(F.size(salts) > 0, F.lit(False))
    keyed = (
        keyed.join(F.broadcast(hot), ["arc", "block"], "left")
        .withColumn("part", F.when(F.col("hot").isNull(), 0).otherwise(2 * earlier_hot + is_hot.cast("int")))
        .withColumn("salt", F.when(is_hot, F.pmod("mark", F.get(salts, F.lit(0))["salts"])).otherwise(F.lit(0)))
        .drop("hot")
    )
    block = ["block", "part", "salt"]
    inside = W.partitionBy("arc", *block).orderBy("place", "own", "mark", "doc_id")
    summed = keyed.withColumn("upto", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    block_sums = keyed.groupBy("arc", *block).agg(F.sum("size").alias("bytes"))
    earlier = W.partitionBy("arc").orderBy(*block).rowsBetween(W.unboundedPreceding, -1)
    offsets = block_sums.select("arc", *block, F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("before"))
    # A document goes where its middle byte falls.
    middle = F.col("before") + F.col("upto") - F.shiftright("size", 1) - 1
    placed = summed.join(offsets, ["arc", *block]).withColumn(
        "shard", F.get("shards", F.size(F.filter("starts", lambda s: s <= middle)) - 1)
    )
    ranked = placed.withColumn(
        "rank", F.row_number().over(W.partitionBy("arc", *block, "shard").orderBy("upto"))
    )
    counts = placed.groupBy("shard", "arc", *block).agg(F.count("*").alias("rows"))
    before = W.partitionBy("shard").orderBy("arc", *block).rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select("shard", "arc", *block, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    return ranked.join(firsts, ["shard", "arc", *block]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - 1).cast("bigint").alias("slot")
    )
