"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

Short test items are looked for inside long documents by containment: the share of
the item's word shingles that the document has. The similarity of whole sketches
says nothing there, as the document is so much larger; containment needs a sketch
of the item alone. Items are partitioned by their number n of shingles, and an item
keeps its n - ceil(t n) + 1 smallest hashes: a document that lacks all of these
lacks more than a share 1 - t of the item, so the search misses nothing. A
document shingle that meets a sketch makes a candidate, if the document has enough
shingles for the partition. Candidates are verified by the shingles themselves.

Whether a text contains an item depends on the text alone, so candidates go by
content: copies of a text are verified once, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platenlog.llm.content import CONTENT, content, one_of_each
from platenlog.plans.session import work_path

WORDS = 5
THRESHOLD = 0.8
# Sketch hashes that may be broadcast, some 40 bytes each; more are joined by shuffle.
BROADCAST_HASHES = 500_000


def _words(text: Column) -> Column:
    """Lower-cased runs of characters other than space and tab to carriage return."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda word: word != "")


def _starts(words: Column, width: Column) -> Column:
    """Where shingles of ``width`` words start, from 1; none where there are too few words."""
    last = F.size(words) - width + 1
    return F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def _mark(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(words, at - 1 + k) for k in range(width)])


def _shingles(words: Column, width: Column) -> Column:
    return F.array_distinct(
        F.transform(_starts(words, width), lambda at: F.array_join(F.slice(words, at, width), " "))
    )


def prepared_items(items: DataFrame, item_id: str, text: str, words: int, threshold: float) -> DataFrame:
    """``item_id, width, shingles, n, need, sketch``: need is the least number of shingles to share."""
    split = items.select(F.col(item_id).cast("bigint").alias("item_id"), _words(F.col(text)).alias("words"))
    split = split.where("item_id is not null and size(words) > 0").withColumn(
        "width", F.least(F.lit(words), F.size("words"))
    )

    def marks(width: int) -> Column:
        return F.transform(_starts(F.col("words"), F.col("width")), lambda at: _mark(F.col("words"), at, width))

    mark = marks(words)
    for width in range(1, words):
        mark = F.when(F.col("width") == width, marks(width)).otherwise(mark)
    made = split.select(
        "item_id",
        "width",
        _shingles(F.col("words"), F.col("width")).alias("shingles"),
        F.sort_array(F.array_distinct(mark)).alias("marks"),
    ).withColumn("n", F.size("shingles"))
    made = made.withColumn("need", F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int"))
    return made.withColumn("sketch", F.slice("marks", F.lit(1), F.col("n") - F.col("need") + 1)).drop("marks")


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    broadcast_hashes: int = BROADCAST_HASHES,
) -> DataFrame:
    """``c1, c2, item_id, n_shared, n_shingles``: which contents of ``docs`` contain which items."""
    spark = docs.sparkSession
    own = docs.select(
        *content(F.col(text)), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-1)).alias("id"), F.col(text).alias("text")
    )
    ready = prepared_items(items, item_id, item_text, words, threshold).checkpoint()
    sketch = ready.select("item_id", "width", "need", F.explode("sketch").alias("mark"))
    # One row for each width that occurs, `words` at most.
    sizes = {r.width: r["count"] for r in sketch.groupBy("width").count().collect()}
    if sum(sizes.values()) <= broadcast_hashes:
        sketch = F.broadcast(sketch)

    def met(width: int) -> DataFrame:
        split = own.select(*CONTENT, _words(F.col("text")).alias("words"))
        marks = F.transform(_starts(F.col("words"), F.lit(width)), lambda at: _mark(F.col("words"), at, width))
        seen = split.select(*CONTENT, (F.size("words") - width + 1).alias("most"), F.explode(marks).alias("mark"))
        return (
            seen.join(sketch.where(F.col("width") == width), "mark")
            .where(F.col("most") >= F.col("need"))
            .select(*CONTENT, "item_id")
        )

    path = work_path(spark, "contained")
    found = own.select(*CONTENT, F.lit(0).cast("bigint").alias("item_id")).limit(0)
    for width in sorted(sizes):
        found = found.unionByName(met(width)) if width != min(sizes) else met(width)
    # Written, so that Spark knows its size when it joins it to the texts.
    found.distinct().write.parquet(path)
    found = spark.read.schema("c1 bigint, c2 bigint, item_id bigint").parquet(path)
    texts = one_of_each(own, found.select(*CONTENT).distinct(), broadcast_hashes)
    judged = (
        texts.select(*CONTENT, _words(F.col("text")).alias("words"))
        .join(found, CONTENT)
        .join(ready, "item_id")
        .withColumn(
            "n_shared", F.size(F.array_intersect("shingles", _shingles(F.col("words"), F.col("width"))))
        )
    )
    return judged.where(F.col("n_shared") >= F.col("need")).select(
        *CONTENT, "item_id", F.col("n_shared").cast("bigint"), F.col("n").cast("bigint").alias("n_shingles")
    )


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    broadcast_hashes: int = BROADCAST_HASHES,
) -> DataFrame:
    """``doc_id, item_id, n_shared, n_shingles, containment`` for every document and item it contains.

    An item is contained if the document has a share of at least ``threshold`` of
    its distinct shingles of ``words`` words, lower-cased; an item of fewer words is
    one shingle. Items without words or id are not looked for; a null or empty
    text contains none. Repeated documents and items give repeated rows, a null
    document id stays null; other columns are ignored; empty tables give no rows.
    """
    found = contained_items(docs, items, doc_id, text, item_id, item_text, words, threshold, broadcast_hashes)
    ids = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), *content(F.col(text)))
    return ids.join(found, CONTENT).select(
        "doc_id", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    )


def without_contaminated(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings
) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item."""
    found = contained_items(docs, items, doc_id, text, **settings).select(*CONTENT).distinct()
    found = found.toDF("__c1", "__c2")
    columns = [F.col(f"`{name}`") for name in docs.columns]
    c1, c2 = content(F.col(text))
    return docs.join(found, (c1 == F.col("__c1")) & (c2 == F.col("__c2")), "left_anti").select(*columns)
