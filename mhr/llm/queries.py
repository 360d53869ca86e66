"""Registered queries of the ten operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, licenses, mixing, mpeg, ngram_join, packing, pii, quality, topk, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_html(table(spark, sf_dir, "pages"))


def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC files and read back as the chunked record table; payload as base64, for the comparison."""
    rows = warc.read_chunks(warc.write_warc(table(spark, sf_dir, "pages")))
    return rows.withColumn("payload_base64", F.translate(F.base64("payload"), "\r\n", "")).drop("payload", "path", "range_start", "record_no")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: the class that its similar pairs connect it to, and the number of its links."""
    return ngram_join.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item is a query over all documents."""
    return topk.top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact_pii(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_mpeg_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio columns of streams that carry each document's whole text, and a digest of what is read back out of them; the
    lists as text, for the comparison."""
    found = mpeg.mpeg_columns(mpeg.synthetic_media(table(spark, sf_dir, "documents")), payload=True)
    as_text = {c: F.array_join(F.col(c).cast("array<string>"), " ") for c in ("toc", "seek")}
    return found.withColumns(as_text).withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_md5": F.md5("payload")}).drop("payload")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_warc_chunks,
        op3_ngram_jaccard_join,
        op4_license_scan,
        op5_exact_topk,
        op6_pii_redaction,
        op7_quality_classifier,
        op8_best_fit_packing,
        op9_mpeg_columns,
        op10_source_mixing,
    )
}

#: SQL can't express the others: trained models, alignment, seeded xxhash64.
ORACLE: dict[str, str] = {"op2_warc_chunks": warc.SQL, "op3_ngram_jaccard_join": ngram_join.SQL, "op5_exact_topk": topk.SQL, "op9_mpeg_columns": mpeg.SQL}
