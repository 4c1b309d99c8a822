"""The corpus pipeline: each stage takes the documents that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession

from quarry.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from quarry.llm.common import file_rows, fresh, remove, table


def rows_of(docs: DataFrame) -> list[Column] | None:
    """What tells the rows apart: their places in the files that `docs` is read from, or None where it is not."""
    try:
        docs.select(*file_rows())
    except AnalysisException:
        return None
    return file_rows()


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie outside their group's fences go."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines near an earlier one go, however short, and documents of which nothing is left."""
    return line_dedup.without_duplicates(docs, row_key=rows_of(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: near in SimHash bits and of a five-word shingle similarity of 0.8 or more."""
    return simhash.keep_first(docs, row_key=rows_of(docs))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 of a benchmark item's shingles go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and their places in sequences of 4096 tokens."""
    return packing.pack(docs, size=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash", near_duplicates),
    ("decontaminate", contamination),
    ("packing", packed),
]

#: No stage is expressible in SQL (sketches, edit distance, fingerprints, a tokenizer).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over `documents`: each stage's result is written, reread as the next one's input and then deleted.

    Null texts and those without words go in the first stage, null ids rank as the stages' operators say; texts of any
    length are treated whole; of equal rows one is left by the third stage; an empty table gives no rows; columns that
    `documents` has beside its own go along unread, whatever they are called, up to the last stage.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
