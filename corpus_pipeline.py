"""The corpus pipeline: from raw documents to packed training batches.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all
but the last return the columns of ``docs``. A stage's rows are written as Parquet and
read again as the next one's ``docs``. What each does with nulls, repeats, ties,
and empty tables is said where its operator is defined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platenlog.llm import decontamination, language, lines, packing, similar
from platenlog.plans.session import work_path

# A text goes if it has more unknown three-grams than labelled texts of its length, by so many standard deviations.
UNKNOWN_SIGMAS = 3.0


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labels; without a letter, or foreign to all, they go."""
    return language.accepted(docs, least=0.0, sigmas=UNKNOWN_SIGMAS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that come earlier in the corpus; a document of which nothing is left goes.

    ``n_chars``, if there is one, follows the text.
    """
    kept = lines.dedup_lines(docs).where((F.col("__removed") == 0) | (F.trim("text") != ""))
    length = F.length("text").cast("bigint")
    return kept.select(
        *[length.alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity 0.8 or more), the one with the smallest id."""
    return similar.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches for what is left."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_known_languages),
    ("lines", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_documents),
]

# Language identification is a trained model, which SQL cannot express;
# tests/llm/test_pipeline.py holds the other stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
