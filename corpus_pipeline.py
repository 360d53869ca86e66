"""Corpus pipeline: quality -> near duplicates -> personal data -> source mixing -> packing.

Extra columns of documents, whatever their names, go through all stages but the last; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mhr.llm import mixing, ngram_join, packing, pii, quality
from mhr.llm.common import stored

def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.  Null, empty and tokenless texts go; rows that repeat, and null ids, are
    judged like any other.  Without labels of both classes all stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each connected group of near duplicates, and all that have none; of rows that repeat an id
    and text one.  Null and wordless texts and null ids are in no group and stay."""
    return ngram_join.drop_near_duplicates(docs)


def private_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data redacted; n_chars follows the text, null for a null one."""
    return pii.redact_column(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen so that no source exceeds its target weight of all tokens; one that has less is kept whole.  A null source
    is one of its own; null texts are never chosen, empty ones cost nothing; of rows that repeat one is chosen."""
    return mixing.mix_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document stands in which training sequence.  Null, empty and blank texts stand in none; rows that repeat are
    packed each."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("pii", private_data_out),
    ("mixing", mixed_sources),
    ("packing", packed),
]
#: SQL can't express the classifiers and searches of these stages; tests hold `run` against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
