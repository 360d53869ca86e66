"""Multi-head vectors for systems that know one vector a document."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mhr.functions.vectors import doubles

ORDER = ("semantic", "temporal", "structural")
STRATEGIES = ("semantic_only", "concatenation", "per_head_rrf")


@dataclass(frozen=True)
class Capabilities:
    multi_vector: bool = False
    filtering: bool = False
    hybrid: bool = False
    max_batch: int = 1000


def validate(strategy: str, can: Capabilities) -> None:
    """ValueError if the strategy is unknown, or needs several vectors where there is one."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if strategy == "per_head_rrf" and not can.multi_vector:
        raise ValueError("per_head_rrf needs a system of several vectors a document")


def single(vectors: DataFrame, key: str, head: str = "semantic") -> DataFrame:
    """(key, vec): the primary head's vector; a row without it fails."""
    lacking = F.raise_error(F.concat(F.lit("no primary head in "), F.col(key).cast("string")))
    return vectors.select(key, F.when(F.col(head).isNotNull(), doubles(F.col(head))).otherwise(lacking).alias("vec"))


def concatenated(vectors: DataFrame, key: str, heads: Sequence[str] = ORDER) -> DataFrame:
    """(key, vec): the heads' vectors one behind the other, missing ones left out; a row without any fails."""
    vec = F.concat(*[F.coalesce(doubles(F.col(h)), F.array().cast("array<double>")) for h in heads if h in vectors.columns])
    lacking = F.raise_error(F.concat(F.lit("no vectors in "), F.col(key).cast("string")))
    return vectors.select(key, F.when(F.size(vec) > 0, vec).otherwise(lacking).alias("vec"))


def per_head(queries: DataFrame, key: str, enabled: str = "enabled", heads: Sequence[str] = ORDER) -> DataFrame:
    """(key, head, vec) of the heads that a query has and enables (a column of names)."""
    each = F.array(*[F.struct(F.lit(h).alias("head"), doubles(F.col(h)).alias("vec")) for h in heads])
    rows = queries.select(key, F.col(enabled).alias("_on"), F.explode(each).alias("x"))
    return rows.where(F.col("x.vec").isNotNull() & F.array_contains("_on", F.col("x.head"))).select(key, "x.head", "x.vec")
