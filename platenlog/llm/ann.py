"""Approximate nearest neighbours: a graph for each shard, and the shards' results merged.

Equal vectors are one point of the graph with the smallest of their ids, as many as
a result can hold, so a vector that a third of all rows share is one point. Points go to
shards by the hash of the vector. Every shard is searched for every query, in blocks of queries;
what each finds is scored again on the original vectors in double precision and merged.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platenlog.llm.graph import BUILD_BREADTH, LINKS, Graph, build
from platenlog.plans.session import shared_folder, work_path

NEAREST = 20
BREADTH = 96
# At least so many shards, and so many more that none has over SHARD_ROWS points.
SHARDS = 12
SHARD_ROWS = 50_000
# Queries of one block, which a task holds together with one shard.
BLOCK = 16_384
SALTS = 64
INDEX = "dims int, shard int, entry bigint, vectors binary, arrays binary, ids binary"
FOUND = "query_id bigint, mark bigint, vec_id bigint, score double"


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def points_of(vectors: DataFrame, vec_id: str, vector: str, keep: int) -> DataFrame:
    """``vector, mark, dims, ids``: the different usable vectors, each with its ``keep`` smallest ids."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector")).where(
        F.col("vec_id").isNotNull() & usable(F.col("vector"))
    )
    rows = rows.withColumn("mark", F.xxhash64("vector")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    # A vector that very many rows share: its ids are thinned out in SALTS places before they meet.
    for keys in (["mark", "vector", "salt"], ["mark", "vector"]):
        place = F.dense_rank().over(W.partitionBy(*keys).orderBy("vec_id"))
        rows = rows.withColumn("place", place).where(F.col("place") <= keep).dropDuplicates([*keys, "vec_id"])
    return rows.groupBy("mark", "vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn(
        "dims", F.size("vector")
    )


def _pack(arrays: list[np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def _unpack(data: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(data)) as arrays:
        return [arrays[name] for name in arrays.files]


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in column.chunks]
    return np.concatenate(flat).reshape(-1, dims)


def build_index(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    keep: int = NEAREST + 1,
    shards: int = SHARDS,
    shard_rows: int = SHARD_ROWS,
    links: int = LINKS,
    breadth: int = BUILD_BREADTH,
) -> DataFrame:
    """One row for each shard: its vectors, the flat arrays of its graph, and the ids of its points.

    Every usable row is indexed. Vectors of different lengths are in different
    shards and never compared. The index is written to the shared folder.
    """
    spark = vectors.sparkSession
    points = points_of(vectors, vec_id, vector, keep).checkpoint()
    shards = max(shards, -(-points.count() // shard_rows))

    def make(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        # The same points in the same order make the same graph.
        order = np.argsort(rows["mark"].to_numpy(), kind="stable")
        dims, shard = key[0].as_py(), key[1].as_py()
        own = _matrix(rows["vector"], dims)[order]
        ids = [rows["ids"][int(k)].as_py() for k in order]
        graph = build(own.astype(np.float32), links, breadth)
        sizes = np.cumsum([0, *map(len, ids)])
        return pa.table(
            {
                "dims": pa.array([dims], pa.int32()),
                "shard": pa.array([shard], pa.int32()),
                "entry": pa.array([graph.entry], pa.int64()),
                "vectors": pa.array([_pack([own])], pa.binary()),
                "arrays": pa.array(
                    [_pack([graph.points, *graph.members, *(t.astype(np.int32) for t in graph.neighbours)])],
                    pa.binary(),
                ),
                "ids": pa.array([_pack([np.concatenate(ids), sizes])], pa.binary()),
            }
        )

    path = work_path(spark, "ann-index")
    placed = points.select(
        "dims", F.pmod("mark", F.lit(shards)).cast("int").alias("shard"), "mark", "vector", "ids"
    )
    placed.groupBy("dims", "shard").applyInArrow(make, INDEX).write.parquet(path)
    return spark.read.parquet(path)


def search_index(
    index: DataFrame,
    queries: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    nearest: int = NEAREST,
    breadth: int = BREADTH,
    block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found of each usable query, but for its own id."""
    shared_folder(index.sparkSession)
    asked = queries.select(F.col(vec_id).cast("bigint").alias("query_id"), F.col(vector).alias("vector")).where(
        F.col("query_id").isNotNull() & usable(F.col("vector"))
    )
    asked = asked.distinct().withColumn("mark", F.xxhash64("query_id", "vector")).checkpoint()
    blocks = max(1, -(-asked.count() // block))
    dealt = asked.select(
        F.size("vector").alias("dims"), F.pmod("mark", F.lit(blocks)).cast("int").alias("block"), "query_id", "mark", "vector"
    )
    # Each shard meets each block; a pair of them is one task's work.
    met = index.select("dims", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    graphs = index.join(met, ["dims", "shard"])
    sent = dealt.join(met, ["dims", "block"])
    # Columns of their own, as both sides come from the index.
    graphs, sent = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (graphs, sent))

    def look(graph_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        if not graph_rows.num_rows or not query_rows.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "mark": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        (own,) = _unpack(graph_rows["vectors"][0].as_py())
        points, *rest = _unpack(graph_rows["arrays"][0].as_py())
        flat, sizes = _unpack(graph_rows["ids"][0].as_py())
        graph = Graph(points, rest[: len(rest) // 2], rest[len(rest) // 2 :], graph_rows["entry"][0].as_py())
        asked = _matrix(query_rows["vector"], own.shape[1])
        query_ids, marks = query_rows["query_id"].to_numpy(), query_rows["mark"].to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        for k in range(0, len(asked), 256):
            part = asked[k : k + 256]
            level = np.concatenate((part, np.zeros((len(part), 1))), axis=1).astype(np.float32)
            found, _ = graph.search(level, max(breadth, nearest + 1))
            row, col = np.nonzero(found >= 0)
            at = found[row, col]
            score = (own[at].astype(np.float64) * part[row].astype(np.float64)).sum(axis=1)
            # A point for each of its ids, the query's own left out.
            many = sizes[at + 1] - sizes[at]
            row, score = np.repeat(row, many), np.repeat(score, many)
            first = np.repeat(sizes[at], many)
            step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            ids = flat[first + step]
            other = ids != query_ids[k + row]
            row, score, ids = row[other], score[other], ids[other]
            order = np.lexsort((ids, -score, row))
            row, score, ids = row[order], score[order], ids[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best = place < nearest
            out.append((query_ids[k + row[best]], marks[k + row[best]], ids[best], score[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table(
            {
                "query_id": pa.array(columns[0], pa.int64()),
                "mark": pa.array(columns[1], pa.int64()),
                "vec_id": pa.array(columns[2], pa.int64()),
                "score": pa.array(columns[3], pa.float64()),
            }
        )

    keys = ["dims", "shard", "block"]
    found = graphs.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(look, FOUND)
    order = W.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    # An id that stands for several vectors is a neighbour once, by its nearest one.
    once = found.groupBy("query_id", "mark", "vec_id").agg(F.max("score").alias("score"))
    return (
        once.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= nearest)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``nearest`` vectors by inner product.

    Nearest first, from rank 1; ties go to the smaller id; all candidates if they are fewer. Vectors that
    are null, zero, or hold null or non-finite components take no part, nor do null
    ids. A row repeated exactly counts once; an id with several vectors counts by its nearest, and is
    never its own neighbour. Other columns are ignored; empty tables give no rows.
    """
    index = build_index(vectors, vec_id, vector, nearest + 1)
    return search_index(index, queries, vec_id, vector, nearest)
