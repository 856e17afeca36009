"""How far the sources of a language are apart: exact smoothed term shares, compared pair by pair.

Texts that are equal in a language are one text with a multiplicity for each source. It is
tokenized once; what it adds to document frequencies and counts is weighted. Sums are made
inside tasks before anything is shuffled, and of a term only its sum for each source goes on.

A pair of sources differs on the terms that one of them has, and by one and the same amount
on all others. So terms are evaluated in blocks of sources, each only where it occurs, against the
share of a term that does not occur; what is left of the vocabulary is one product.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platenlog.llm.content import CONTENT, content
from platenlog.plans.session import work_path

LEAST_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
PRIOR = 5
# Counts a task holds before it hands them on; a row of its own for each language and term.
HELD = 400_000
# Sources compared at once, and terms of one task's work.
BLOCK = 128
CHUNK = 4096

# A term is a run of these bytes: letters, of which A-Z become a-z, and all of a character beyond ASCII.
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

TEXTS = "lang string, text binary, shares array<struct<source:string,n:bigint>>"
ADDED = "lang string, term string, docs bigint, sources array<string>, counts array<bigint>"
PARTS = "lang string, a int, b int, part bigint"


def collapsed(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """One row for each different text of a language, with how often each source has it.

    Copies are counted by hash, and combine before they are shuffled; of the texts only one
    copy for each task that reads some is moved.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    rows = docs.where(own != "").select(
        _named(lang, "lang"), _named(source, "source"), *content(F.col(text)), F.col(text).cast("binary").alias("text")
    )
    keys = ["lang", *CONTENT]
    counted = rows.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("n"))
    shares = counted.groupBy(*keys).agg(F.collect_list(F.struct("source", "n")).alias("shares"))
    return rows.groupBy(*keys).agg(F.first("text").alias("text")).join(shares, keys).select("lang", "text", "shares")


def _named(column: str, name: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(name)


def term_sums(texts: DataFrame, held: int = HELD) -> DataFrame:
    """``lang, term, docs, sources, counts``: sums over stretches of the texts, a row for each term of a stretch."""

    def flush(docs: dict[str, Counter], counts: dict[tuple[str, str], Counter]) -> Iterator[pa.RecordBatch]:
        for lang, frequency in docs.items():
            places = {term: k for k, term in enumerate(frequency)}
            sources: list[list[str]] = [[] for _ in places]
            sums: list[list[int]] = [[] for _ in places]
            for (own, source), counter in counts.items():
                if own == lang:
                    for term, n in counter.items():
                        k = places[term]
                        sources[k].append(source)
                        sums[k].append(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(places), pa.string()),
                    pa.array(list(places), pa.binary()).cast(pa.string()),
                    pa.array(list(frequency.values()), pa.int64()),
                    pa.array(sources, pa.list_(pa.string())),
                    pa.array(sums, pa.list_(pa.int64())),
                ],
                ["lang", "term", "docs", "sources", "counts"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict[str, Counter] = {}
        counts: dict[tuple[str, str], Counter] = {}
        size = 0
        for batch in batches:
            for lang, text, shares in zip(*(batch.column(k) for k in range(3)), strict=True):
                lang, words = lang.as_py(), text.as_py().translate(TERM_BYTES).split()
                if not words:
                    continue
                shares = shares.as_py()
                own = Counter(words)
                frequency = docs.setdefault(lang, Counter())
                copies = sum(s["n"] for s in shares)
                if copies == 1:
                    frequency.update(own.keys())
                else:
                    for term in own:
                        frequency[term] += copies
                for share in shares:
                    counter, n = counts.setdefault((lang, share["source"]), Counter()), share["n"]
                    before = len(counter)
                    if n == 1:
                        counter.update(words)
                    else:
                        for term, times in own.items():
                            counter[term] += times * n
                    size += len(counter) - before
                if size > held:
                    yield from flush(docs, counts)
                    docs, counts, size = {}, {}, 0
        yield from flush(docs, counts)

    return texts.mapInArrow(run, ADDED)


def kept_terms(sums: DataFrame, least_docs: int) -> DataFrame:
    """``lang, term, n, shares``: the terms in enough documents, with their count in each source that has them."""
    # One shuffle for all three steps. A task adds a row or two for a term, so a frequent one is no more than a row a task.
    dealt = sums.repartition("lang", "term")
    often = dealt.withColumn("all_docs", F.sum("docs").over(W.partitionBy("lang", "term"))).where(
        F.col("all_docs") >= least_docs
    )
    each = often.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("share"))
    added = each.groupBy("lang", "term", F.col("share.sources").alias("source")).agg(F.sum("share.counts").alias("n"))
    return added.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("shares")
    )


def smoothed(n: Column, total: Column, terms: Column, scale: int, prior: int) -> Column:
    """1 + floor(scale (n + prior) / (total + prior terms)), in whole numbers of any size."""

    def wide(c: Column, digits: int) -> Column:
        return c.cast(f"decimal({digits},0)")

    over = wide(F.lit(scale), 12) * wide(n + prior, 20)
    return F.lit(1).cast("bigint") + F.call_function("div", over, wide(total + prior * terms, 20))


def group_table(docs: DataFrame, kept: DataFrame, lang: str, source: str, scale: int, prior: int) -> DataFrame:
    """Every (lang, source) that occurs: its number in the language, its sum over kept terms, the share of an absent term."""
    groups = docs.select(_named(lang, "lang"), _named(source, "source")).distinct()
    sums = (
        kept.select("lang", F.explode("shares").alias("share"))
        .groupBy("lang", F.col("share.source").alias("source"))
        .agg(F.sum("share.n").alias("total"))
    )
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    full = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    absent = smoothed(F.lit(0).cast("bigint"), F.col("total"), F.col("terms"), scale, prior)
    return full.select(
        "*",
        F.when(F.col("terms") > 0, absent).alias("absent"),
        (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).alias("number"),
    )


def pair_parts(placed: DataFrame, groups: DataFrame, block: int, chunk: int) -> DataFrame:
    """``lang, a, b, part`` (a < b by number): what the terms that one of two sources has add to what an absent term would.

    A term goes to the pairs of blocks that have it; pairs of blocks and stretches of the vocabulary are the
    units of work.
    """
    blocks = (
        groups.withColumn("block", F.floor(F.col("number") / block).cast("int"))
        .groupBy("lang", "block")
        .agg(F.array_sort(F.collect_list(F.struct("number", "absent"))).alias("members"))
        .select("lang", "block", F.col("members.absent").alias("absent"))
    )
    terms = placed.groupBy("lang", "term").agg(
        F.first("terms").alias("terms"),
        F.first("sources").alias("sources"),
        F.collect_list(F.struct("number", "p")).alias("shares"),
    )
    held = F.array_distinct(F.transform("shares", lambda s: F.floor(s["number"] / block).cast("int")))
    last = F.floor((F.col("sources") - 1) / block).cast("int")
    met = F.array_distinct(
        F.flatten(
            F.transform(
                held,
                lambda b: F.transform(
                    F.sequence(F.lit(0), last), lambda c: F.struct(F.least(b, c).alias("i"), F.greatest(b, c).alias("j"))
                ),
            )
        )
    )
    met_terms = terms.select(
        "lang",
        F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / chunk)).alias("chunk"),
        "shares",
        F.explode(met).alias("met"),
    ).select("lang", "chunk", "met.i", "met.j", "shares")
    members = F.filter("shares", lambda s: F.floor(s["number"] / block).isin(F.col("i"), F.col("j")))
    rows = (
        met_terms.select("lang", "chunk", "i", "j", members.alias("shares"))
        .join(blocks.select("lang", F.col("block").alias("i"), F.col("absent").alias("absent_i")), ["lang", "i"])
        .join(blocks.select("lang", F.col("block").alias("j"), F.col("absent").alias("absent_j")), ["lang", "j"])
        .select("lang", "i", "j", "chunk", "absent_i", "absent_j", "shares.number", "shares.p")
    )

    def evaluate(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        lang, i, j = (k.as_py() for k in key[:3])
        left, right = (np.array(own[c][0].as_py(), dtype=np.int64) for c in ("absent_i", "absent_j"))
        lengths = np.array([len(n) for n in own["number"]], dtype=np.int64)
        term = np.repeat(np.arange(len(lengths)), lengths)
        number = np.array([k for n in own["number"] for k in n.as_py()], dtype=np.int64)
        p = np.array([k for n in own["p"] for k in n.as_py()], dtype=np.int64)
        sides = []
        for at, absent in ((i, left), (j, right)):
            dense = np.tile(absent, (len(lengths), 1))
            here = number // block == at
            dense[term[here], number[here] - at * block] = p[here]
            sides.append(dense)
        total = np.zeros((len(left), len(right)), dtype=np.int64)
        for k in range(0, len(lengths), 32):
            a, b = (side[k : k + 32] for side in sides)
            total += np.abs(a[:, :, None] - b[:, None, :]).sum(axis=0)
        total -= len(lengths) * np.abs(left[:, None] - right[None, :])
        a, b = np.nonzero(np.ones_like(total))
        numbers = a + i * block, b + j * block
        once = numbers[0] < numbers[1]
        return pa.table(
            {
                "lang": pa.array([lang] * int(once.sum()), pa.string()),
                "a": pa.array(numbers[0][once], pa.int32()),
                "b": pa.array(numbers[1][once], pa.int32()),
                "part": pa.array(total.ravel()[once], pa.int64()),
            }
        )

    parts = rows.groupBy("lang", "i", "j", "chunk").applyInArrow(evaluate, PARTS)
    return parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))


def audit_sources(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_docs: int = LEAST_DOCS,
    top: int = TOP_TERMS,
    scale: int = SCALE,
    prior: int = PRIOR,
    block: int = BLOCK,
    chunk: int = CHUNK,
    held: int = HELD,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances between sources, and the terms that set one apart.

    The vocabulary of a language are the terms in at least ``least_docs`` of its documents. The share of
    a term in a source, or in the whole language, is 1 + floor(scale (n + prior) / (N + prior V)). Part
    ``pair`` gives for every other source of the language the sum of the shares' differences over the
    vocabulary, part ``term`` the ``top`` terms whose share in the source is most above that in the
    language. Rank 1 is the largest value, ties go to the smaller item by UTF-8 bytes.

    Nulls in any of the three columns are as empty strings, which are a language, a source and a text
    like others. Every row counts as a document, repeated ones too. A text without terms adds nothing,
    but its source occurs; a language without kept terms has distances of 0. Texts are read whole.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = work_path(spark, "audit-terms")
    kept_terms(term_sums(collapsed(docs, text, lang, source), held), least_docs).write.parquet(path)
    kept = spark.read.schema(
        "lang string, term string, n bigint, shares array<struct<source:string,n:bigint>>"
    ).parquet(path)
    path = work_path(spark, "audit-groups")
    group_table(docs, kept, lang, source, scale, prior).write.parquet(path)
    groups = spark.read.schema(
        "lang string, source string, total bigint, terms bigint, lang_total bigint, absent bigint, number int"
    ).parquet(path)

    counted = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    each = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("shares").alias("share"))
    placed = (
        each.select("lang", "term", "lang_n", F.col("share.source").alias("source"), F.col("share.n").alias("n"))
        .join(groups, ["lang", "source"])
        .join(counted, "lang")
        .select(
            "lang",
            "term",
            "source",
            "number",
            "terms",
            "sources",
            smoothed(F.col("n"), F.col("total"), F.col("terms"), scale, prior).alias("p"),
            smoothed(F.col("lang_n"), F.col("lang_total"), F.col("terms"), scale, prior).alias("q"),
        )
    )
    apart = placed.where(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")
    )

    parts = pair_parts(placed, groups, block, chunk)
    both = parts.unionByName(parts.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "part"))
    # The pairs are what is asked for: one row for each two sources of a language.
    own = groups.select("lang", "source", "terms", F.col("number").alias("a"), F.col("absent").alias("absent_a"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("b"), F.col("absent").alias("absent_b"))
    rest = F.coalesce(F.col("terms") * F.abs(F.col("absent_a") - F.col("absent_b")), F.lit(0))
    pairs = (
        own.join(other, "lang")
        .where(F.col("a") != F.col("b"))
        .join(both, ["lang", "a", "b"], "left")
        .select(
            "lang",
            "source",
            F.lit("pair").alias("part"),
            "item",
            (F.coalesce("part", F.lit(0)) + rest).cast("bigint").alias("value"),
        )
    )

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    ranked = pairs.withColumn("rank", rank)
    best = apart.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.unionByName(best)
