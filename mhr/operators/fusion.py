"""Fusion of per-head score lists, and the attend operators built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mhr.functions.vectors import project, softmax
from mhr.sources.shared import stored

from .search import lists_to_fuse, lists_to_gate, ranked, weight_of

OVERFETCH, LEAST = 5, 20


def fetch_count(k: int) -> int:
    return max(OVERFETCH * k, LEAST)


def max_normalised(lists: DataFrame) -> DataFrame:
    """Scores over the best of their (qid, head), where that is above zero."""
    top = F.max("score").over(Window.partitionBy("qid", "head"))
    return lists.withColumn("score", F.when(top > 0, F.try_divide("score", top)).otherwise(F.col("score")))


def fuse(lists: DataFrame, weight: Column, k: int | None = None) -> DataFrame:
    """(qid, rank, doc_num, score): weighted sums over heads."""
    summed = lists.groupBy("qid", "doc_num").agg(F.round(F.sum(F.col("score") * weight), 9).alias("score"))
    return ranked(summed, ["qid"], k).select("qid", "rank", "doc_num", "score")


def fuse_both(lists: DataFrame, a: Column, b: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """`fuse` by two weightings: the lists are made and summed once, and what is among either's best is stored."""
    sums = lists.groupBy("qid", "doc_num").agg(*[F.round(F.sum(F.col("score") * w), 9).alias(n) for n, w in (("a", a), ("b", b))])
    place = lambda n: F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(n), "doc_num")).cast("bigint")
    both = stored(sums.withColumn("ra", place("a")).withColumn("rb", place("b")).where((F.col("ra") <= k) | (F.col("rb") <= k)), "fused")
    return tuple(both.where(F.col(f"r{n}") <= k).select("qid", F.col(f"r{n}").alias("rank"), "doc_num", F.col(n).alias("score")) for n in "ab")


def weighted_fuse(lists: DataFrame, weights: dict[str, float], k: int | None = None) -> DataFrame:
    """Weights by head name; a head without one counts 1."""
    return fuse(lists, weight_of(F.col("head"), weights), k)


def fuse_by_best(lists: DataFrame, weights: dict[str, float], k: int | None = None) -> DataFrame:
    """(qid, rank, doc_num, score): weighted sums over heads, as shares of the query's best sum where that is above zero."""
    summed = lists.groupBy("qid", "doc_num").agg(F.sum(F.col("score") * weight_of(F.col("head"), weights)).alias("s"))
    top = F.max("s").over(Window.partitionBy("qid"))
    shared = summed.withColumn("score", F.round(F.when(top > 0, F.try_divide("s", top)).otherwise(F.col("s")), 9))
    return ranked(shared, ["qid"], k).select("qid", "rank", "doc_num", "score")


def reciprocal_rank_fusion(lists: DataFrame, k: int | None = None, constant: int = 0) -> DataFrame:
    """Sums of 1 / (constant + rank) over lists (qid, head, doc_num, rank)."""
    return fuse(lists.withColumn("score", 1.0 / (F.col("rank") + constant)), F.lit(1.0), k)


def gate(queries: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float], heads: Sequence[str], vec: str) -> DataFrame:
    """(qid, head, gate): softmax(W q + b); uniform where the net has another number of outputs than there are heads."""
    if len(weights) == len(heads):
        logits = F.zip_with(project(F.col(vec), weights), F.array(*map(F.lit, map(float, bias))), lambda x, b: x + b)
        w = softmax(logits)
    else:
        w = F.array_repeat(F.lit(1.0 / len(heads)), len(heads))
    named = F.arrays_zip(F.array(*map(F.lit, heads)).alias("head"), w.alias("gate"))
    return queries.select("qid", F.explode(named).alias("x")).select("qid", F.col("x.head").alias("head"), F.col("x.gate").alias("gate"))


def attend(vectors: DataFrame, queries: DataFrame, heads: Sequence[str], k: int = 10, weights: dict[str, float] | None = None, gates: DataFrame | None = None, min_weight: float | None = None, temporal_decay: float | None = None, metric: str = "cosine") -> DataFrame:
    """(qid, rank, doc_num, score): per-head lists of max(5k, 20), max-normalised, weighted, summed, cut to k.

    Weights: `weights` by name (absent ones 1), else `gates` (qid, head, gate), else 1 / heads asked for.  temporal_decay
    multiplies the temporal head's weight; heads below min_weight drop out.  A head that no table column has is skipped,
    its share of a uniform weight is not given to others.
    """
    there = [h for h in heads if h in vectors.columns and h in queries.columns]
    decay = 1.0 if temporal_decay is None else float(temporal_decay)
    if weights is not None or gates is None:  # known by name: heads that drop out aren't searched, documents that can't win not shuffled
        by_name = {h: float(1.0 / len(heads) if weights is None else weights.get(h, 1.0)) * (decay if h == "temporal" else 1.0) for h in there}
        by_name = {h: w for h, w in by_name.items() if min_weight is None or w >= min_weight}
        return fuse(lists_to_fuse(vectors, queries, by_name, fetch_count(k), k, metric), weight_of(F.col("head"), by_name), k)
    w = gates.select("qid", "head", F.when(F.col("head") == "temporal", F.col("gate") * decay).otherwise(F.col("gate")).alias("w"))
    w = w if min_weight is None else w.where(F.col("w") >= min_weight)
    return fuse(lists_to_gate(vectors, queries, there, w, fetch_count(k), k, metric).join(w, ["qid", "head"]), F.col("w"), k)


def attend_hybrid(dense: DataFrame, sparse: DataFrame, k: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (qid, rank, doc_num), without a constant."""
    both = dense.select("qid", "doc_num", "rank").unionByName(sparse.select("qid", "doc_num", "rank"))
    return reciprocal_rank_fusion(both, k)


def hydrate(results: DataFrame, docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Adds the documents' fields; results whose document is gone keep nulls."""
    return results.join(docs.select(F.col("doc_id").alias("doc_num"), *fields), "doc_num", "left")
