"""Line dedup by a deletion-neighbourhood join.

Two lines are alike if they are equal or, from ``MIN_CHARS`` characters up, one
edit turns one into the other. Lines one edit apart have a common variant with
one character deleted: of both at the same place (one replaced by another), or
of the longer one, equal to the shorter one as it is. So variants are emitted as
hashed keys and joined where equal, the partner found is verified by its edit
distance, and the earliest line of the corpus stays.

Emitting a variant for every character of every line would multiply the corpus by the
length of its lines. Lines one edit apart also agree before and behind the edit, so
lines are first joined on all but a half of themselves, the few that meet somewhere
on all but an eighth, and only those that still meet emit variants, and only for
deletions inside that eighth. No pair one edit apart is lost on the way.

Nobody is paired with everybody: lines that lack the same place are one edit from each
other, so each needs the earliest of them only; a line as it is equals a variant
of many longer ones, and each side needs only the earliest of the other. All of that is grouped
minima and joins on a key, whatever the number of lines that share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platenlog.plans.session import shared_folder, work_path

MIN_CHARS = 20
PARTS = 8
# Rows of keys that a Python task sends on at once, four to a line.
EMIT = 50_000
# Lines whose ids may be broadcast, some 60 bytes each; more are joined by shuffle.
BROADCAST_LINES = 500_000
LINE = ["h1", "h2"]


def _content(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _occurrences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc, content, n, line, h1, h2``: every line with a character that is not blank."""
    own = docs.select(
        F.col(doc_id).cast("bigint").alias("doc"),
        _content(F.col(text)).alias("content"),
        F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n", "line"),
    ).where(F.trim("line") != "")
    return own.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), F.col("line"))})


def part_keys(line: Column, parts: int) -> Column:
    """Array of (t, part, key): the line without that part, for pairs whose longer line has t characters.

    A pair differs inside part p of the longer line; both agree on what is before it and on
    what is behind it, counted from the end.
    """

    def keys(t: Column) -> list[Column]:
        made = []
        for part in range(parts):
            low, high = F.floor(t * part / parts).cast("int"), F.floor(t * (part + 1) / parts).cast("int")
            key = F.xxhash64(
                t, F.lit(part), F.substring(line, F.lit(1), low), F.right(line, t - high)
            )
            made.append(F.struct(t.alias("t"), F.lit(part).alias("part"), key.alias("key")))
        return made

    return F.array(*keys(F.length(line)), *keys(F.length(line) + 1))


def half_keys(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """``h1, key``: :func:`part_keys` of the halves of every long enough line, four a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            marks: list[int] = []
            keys: list[int] = []
            for value in batch.column(0):
                for line in (value.as_py() or "").split("\n"):
                    size = len(line)
                    if size < min_chars or not line.strip(" "):
                        continue
                    whole = line.encode()
                    marks.append(xxhash.xxh64_intdigest(whole, 42))
                    for t in (size, size + 1):
                        half = t // 2
                        # Bytes are cut where characters are.
                        at = half if len(whole) == size else len(line[:half].encode())
                        back = size - (t - half)
                        back = back if len(whole) == size else len(line[:back].encode())
                        keys += [digest(whole[back:], 2 * t), digest(whole[:at], 2 * t + 1)]
                if len(marks) > EMIT:
                    yield _rows(marks, keys)
                    marks, keys = [], []
            yield _rows(marks, keys)

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "h1 bigint, key bigint")


def _rows(marks: list[int], keys: list[int]) -> pa.RecordBatch:
    h1 = np.repeat(np.array(marks, dtype=np.uint64), 4).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(h1), pa.array(np.array(keys, dtype=np.uint64).view(np.int64))], ["h1", "key"])


def _meeting(keyed: DataFrame) -> DataFrame:
    """Rows of ``h1, h2, t, part, key`` whose key another line has too."""
    met = keyed.groupBy("t", "part", "key").agg(F.count("*").alias("lines")).where("lines > 1")
    return keyed.join(met, ["t", "part", "key"]).drop("lines")


def _bounded(small: DataFrame, path: str, schema: str, most: int) -> DataFrame:
    """The rows, written; to be broadcast if they are at most so many."""
    small.write.parquet(path)
    held = small.sparkSession.read.schema(schema).parquet(path)
    return F.broadcast(held) if held.count() <= most else held


def near_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int, broadcast_lines: int) -> DataFrame:
    """``h1, h2`` of the lines with an earlier line one edit away."""
    spark = docs.sparkSession
    keyed = half_keys(docs, text, min_chars)
    # The key names its part and length, so different lines with a key in common may be one edit apart.
    met = (
        keyed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key")
    )
    met = _bounded(met, work_path(spark, "line-keys"), "key bigint", broadcast_lines)
    some = keyed.join(met, "key", "left_semi").select("h1").distinct()
    some = _bounded(some, work_path(spark, "some-lines"), "h1 bigint", broadcast_lines)
    some = _occurrences(docs, doc_id, text).join(some, "h1", "left_semi")
    texts = (
        some.groupBy(*LINE)
        .agg(F.min(F.struct("doc", "content", "n")).alias("first"), F.first("line").alias("line"))
        .checkpoint()
    )
    meets = _meeting(texts.select(*LINE, F.inline(part_keys(F.col("line"), PARTS))))
    meets = meets.groupBy(*LINE).agg(F.collect_set(F.struct("t", "part")).alias("parts"))
    # Cut off here: all that follows reads these lines more than once, and the driver plans and compiles what is before them each time.
    close = texts.join(meets, LINE).checkpoint()
    t, part, line = F.col("t"), F.col("part"), F.col("line")
    low, high = F.floor(t * part / PARTS).cast("int"), F.floor(t * (part + 1) / PARTS).cast("int")
    without = F.transform(
        F.sequence(low, F.greatest(low, high - 1)),
        lambda at: F.struct(
            at.alias("at"),
            F.xxhash64(F.concat(F.substring(line, F.lit(1), at), F.right(line, F.length(line) - at - 1))).alias("variant"),
        ),
    )
    own = F.struct("first", *LINE)

    def key(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("key"))

    # A line as it is can only be the shorter of a pair; cut, it is the longer or one of two as long.
    spread = close.select(own.alias("own"), "line", F.inline("parts"))
    cut = spread.where((F.length("line") == t) & (high > low)).select("own", "t", F.inline(without))
    replaced = key("replaced", F.xxhash64(F.lit("replaced"), "t", "at", "variant"))
    cut = cut.select("own", F.inline(F.array(replaced, key("longer", F.col("variant")))))
    # The variant of a longer line meets a shorter line by the hash of their text.
    whole = close.where(F.exists("parts", lambda p: p["t"] == F.length("line") + 1))
    keyed = cut.unionByName(whole.select(own.alias("own"), F.lit("shorter").alias("kind"), F.col("h1").alias("key")))

    def earliest(kind: str) -> Column:
        return F.min(F.when(F.col("kind") == kind, F.col("own"))).alias(kind)

    met = (
        keyed.groupBy("key")
        .agg(*map(earliest, ("replaced", "longer", "shorter")), F.count_if(F.col("kind") == "replaced").alias("met"))
        .where("met > 1 or (longer is not null and shorter is not null)")
    )
    other = F.when(F.col("kind") == "replaced", F.col("replaced")).when(F.col("kind") == "longer", F.col("shorter"))
    pairs = keyed.join(met, "key").select("own", other.otherwise(F.col("longer")).alias("other"))
    found = (
        pairs.where(F.col("other.first") < F.col("own.first"))
        .select("own.h1", "own.h2", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2"))
        .distinct()
    )
    others = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("other"))
    verified = found.join(texts, LINE).join(others, ["o1", "o2"])
    return verified.where(F.levenshtein("line", "other", 1) == 1).select(*LINE).distinct()


def repeated_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """``doc, content, removed``: the numbers (from 0) of the lines to go, for each document that loses any.

    Lines are compared as they are. A line goes if an equal one, or one an edit away, comes earlier
    in the corpus: in order of document id, hash of the text, number of the line. What
    earlier lines lose themselves does not count. Blank lines are not compared and stay.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    seen = _occurrences(docs, doc_id, text)
    repeated = (
        seen.groupBy(*LINE)
        .agg(F.min(F.struct("doc", "content", "n")).alias("first"), F.count("*").alias("times"))
        .where("times > 1")
        .select(*LINE, "first")
    )
    kind = "h1 bigint, h2 bigint, first struct<doc:bigint,content:bigint,n:int>"
    repeated = _bounded(repeated, work_path(spark, "repeated-lines"), kind, broadcast_lines)
    near = near_lines(docs, doc_id, text, min_chars, broadcast_lines)
    near = _bounded(near, work_path(spark, "near-lines"), "h1 bigint, h2 bigint", broadcast_lines)
    places = seen.select("doc", "content", "n", *LINE)
    later = places.join(repeated, LINE).where(F.struct("doc", "content", "n") != F.col("first"))
    gone = later.select("doc", "content", "n").unionByName(places.join(near, LINE).select("doc", "content", "n"))
    return gone.groupBy("doc", "content").agg(F.collect_set("n").alias("removed"))


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """The rows of ``docs``, all columns, with ``text`` less its repeated lines, and ``__lines`` and ``__removed``.

    A null text stays null, an empty one empty; documents that lose all lines stay, with an empty
    text. A row that repeats another (same id and text) is treated as that one: both lose the same
    lines. A null id comes before all others. Columns of other names pass through; an empty table
    gives no rows.
    """
    gone = repeated_lines(docs, doc_id, text, min_chars, broadcast_lines)
    columns = [F.col(f"`{name}`") for name in docs.columns if name != text]
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__gone"))
    joined = docs.withColumns(
        {"__doc": F.col(doc_id).cast("bigint"), "__content": _content(F.col(text))}
    ).join(
        gone.select(F.col("doc").alias("__doc1"), F.col("content").alias("__content1"), F.col("removed").alias("__gone")),
        F.col("__doc").eqNullSafe(F.col("__doc1")) & (F.col("__content") == F.col("__content1")),
        "left",
    )
    rebuilt = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(
        F.array_join(F.transform(kept, lambda k: F.get(split, k)), "\n")
    )
    return joined.select(
        *columns,
        rebuilt.alias(text),
        F.size(split).cast("bigint").alias("__lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint").alias("__removed"),
    )
