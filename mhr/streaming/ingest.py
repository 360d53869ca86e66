"""Streaming ingest: log files of (seq, op, key, ts, payload, crc) arrive in a folder and are folded into a table.

The checkpoint is the write-ahead log; a batch is written to a folder of its own number and overwritten on retry, so every
row counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mhr.sources.store import LOG, crc_of, latest


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(LOG).parquet(folder)


def append(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends rows whose checksum holds, batch by batch, until what has arrived is read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where(F.col("crc") == crc_of(F.col("payload"))).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def view(spark: SparkSession, table: str) -> DataFrame:
    """Latest live rows of the appended table."""
    return latest(spark.read.schema(LOG + ", batch bigint").parquet(table).drop("batch"))


def rates(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each tumbling window and kind; works on streams, with a watermark, and on tables."""
    src = events.withWatermark(ts, late) if events.isStreaming else events
    return src.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
