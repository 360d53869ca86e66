"""Consistent-hash routing and shard metadata."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VNODES = 100


def ring(spark: SparkSession, shards: list[int], vnodes: int = VNODES) -> DataFrame:
    """(shard, point), `vnodes` of each shard."""
    base = spark.createDataFrame([(s,) for s in shards], "shard bigint").select("shard", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("v"))
    return base.select("shard", position(F.concat(F.lit("shard:"), F.col("shard").cast("string"), F.lit(":vnode:"), F.col("v").cast("string"))).alias("point"))


def position(key: Column) -> Column:
    """Place on the ring: 60 bits of MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")


def route(keys: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """(key, shard): the first point at or after the key's place, round the end.

    The ring is small metadata: its points are counted first, a million at most, then broadcast sorted; keys aren't shuffled.
    """
    if points.count() > 1_000_000:
        raise ValueError("a ring of more than a million points")
    found = sorted((r.point, r.shard) for r in points.collect())
    shared = keys.sparkSession.sparkContext.broadcast((np.array([p for p, _ in found], np.int64), np.array([s for _, s in found], np.int64)))

    @F.pandas_udf("bigint")
    def of(places):
        at, shard = shared.value
        known = places.notna()
        out = places.astype("object")
        out[known] = shard[np.searchsorted(at, places[known].to_numpy(np.int64)) % len(at)]
        return out

    return keys.select(key, of(position(F.col(key).cast("string"))).alias("shard"))


def assign(shards: DataFrame, shard: int, head: str) -> DataFrame:
    """Shards (shard, heads) with `head` added to one of them, once."""
    return shards.withColumn("heads", F.when(F.col("shard") == shard, F.array_union("heads", F.array(F.lit(head)))).otherwise(F.col("heads")))


def unassign(shards: DataFrame, shard: int) -> DataFrame:
    """Shards without one of them."""
    return shards.where(F.col("shard") != shard)


def shards_of_head(shards: DataFrame, head: str) -> DataFrame:
    """Shards (shard, heads) that hold a head."""
    return shards.where(F.array_contains("heads", head)).select("shard")


def healthy(replicas: DataFrame) -> DataFrame:
    return replicas.where("healthy")


def scatter_gather(hits: DataFrame, k: int) -> DataFrame:
    """(qid, rank, doc_num, score): the best of shards' hits (shard, qid, doc_num, score), gate 1, ids summed."""
    summed = hits.groupBy("qid", "doc_num").agg(F.round(F.sum("score"), 9).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_num")
    return summed.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).select("qid", "rank", "doc_num", "score")
