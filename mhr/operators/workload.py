"""Workloads to measure retrieval with: difficulty levels, seeded corpora and queries, head combinations, failures, run protocols.

Random numbers are digests of seed and place, so a corpus is the same on every retry, in any engine.
"""

from __future__ import annotations

import math
import time
import tomllib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mhr.functions.vectors import conflicting, doubles, noisy, normalised


@dataclass(frozen=True)
class Difficulty:
    contrast: float
    overlap: float
    noise: float
    density: float


LEVELS = {
    "easy": Difficulty(0.15, 0.0, 0.05, 0.01),
    "medium": Difficulty(0.3, 0.1, 0.1, 0.02),
    "hard": Difficulty(0.5, 0.2, 0.15, 0.05),
    "very_hard": Difficulty(0.65, 0.35, 0.2, 0.1),
    "super_hard": Difficulty(0.75, 0.5, 0.25, 0.2),
    "extremely_hard": Difficulty(0.85, 0.65, 0.3, 0.4),
}
ALL = ("semantic", "temporal", "structural")
COMBINATIONS = {
    "semantic_only": ALL[:1],
    "temporal_only": ALL[1:2],
    "structural_only": ALL[2:],
    "semantic_temporal": ALL[:2],
    "semantic_structural": (ALL[0], ALL[2]),
    "temporal_structural": ALL[1:],
    "all_heads": ALL,
    "all_heads_learned_gating": ALL,
}


@dataclass(frozen=True)
class Failure:
    kind: str
    amount: float = 0.0
    share: float = 1.0
    head: str = "temporal"


FAILURES = {
    "corruption_10": Failure("corruption", 0.5, 0.1),
    "corruption_25": Failure("corruption", 0.5, 0.25),
    "corruption_50": Failure("corruption", 0.5, 0.5),
    "missing_head": Failure("missing"),
    "conflicting_head": Failure("conflicting"),
    "adversarial_query": Failure("query", 0.3),
    "noisy_query": Failure("query", 0.2),
}
#: Each experiment: the heads that are on, and what fails.
EXPERIMENTS: dict[str, tuple[tuple[str, ...], Failure | None]] = {"standard": (ALL, None)} | {c: (h, None) for c, h in COMBINATIONS.items()} | {f: (ALL, x) for f, x in FAILURES.items()}


def unit(*parts: Column | str) -> Column:
    """A number from 0 to 1 from the MD5 of the parts joined by colons."""
    key = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 10), 16, 10).cast("bigint") / float(1 << 40)


def _places(dim: int) -> Column:
    return F.sequence(F.lit(0), F.lit(dim - 1))


def clustered(spark: SparkSession, n: int, heads: Sequence[str] = ALL, dim: int = 128, level: str = "easy", seed: int = 42) -> DataFrame:
    """(doc_num, a column a head): document i lies about the random unit centre i mod clusters, with the level's noise, as a unit vector."""
    d = LEVELS[level]
    clusters = max(1, math.ceil(n * d.density))
    docs = spark.range(n).select(F.col("id").alias("doc_num"), (F.col("id") % clusters).alias("_c"))
    for h in heads:
        docs = docs.withColumn("_v", normalised(F.transform(_places(dim), lambda j: unit(f"{seed}:c:{h}", F.col("_c"), j) - 0.5)))  # noqa: B023
        docs = docs.withColumn(h, normalised(F.transform("_v", lambda x, j: x + unit(f"{seed}:d:{h}", F.col("doc_num"), j) * d.noise)))  # noqa: B023
    return docs.select("doc_num", *heads)


def queries_of(docs: DataFrame, n: int) -> DataFrame:
    """(qid, the heads' columns): query i is document i modulo their number (doc_num 0, 1, ...)."""
    count = docs.count()
    asked = docs.sparkSession.range(n).select(F.col("id").alias("qid"), (F.col("id") % max(1, count)).alias("doc_num"))
    return asked.join(docs, "doc_num").drop("doc_num")


def synthetic(spark: SparkSession, n: int, dim: int, seed: int = 42, key: str = "doc_num") -> DataFrame:
    """(key, semantic): uniform unit vectors."""
    return spark.range(n).select(F.col("id").alias(key), normalised(F.transform(_places(dim), lambda j: unit(f"{seed}:{key}", F.col("id"), j) - 0.5)).alias("semantic"))


def waves(spark: SparkSession, n: int, dim: int = 256) -> DataFrame:
    """(doc_num, vec): unit vectors of a sine pattern, raised on every tenth dimension by the id modulo ten."""
    i = F.col("id")
    raw = F.transform(_places(dim), lambda j: F.sin(i * 0.1 + j * 0.3) * (i % 7 + 1) * 0.15 + F.when(j % 10 == i % 10, 0.5).otherwise(0.0))
    return spark.range(n).select(i.alias("doc_num"), normalised(raw).alias("vec"))


def failed_documents(docs: DataFrame, failure: Failure | None, key: str = "doc_num", seed: int = 42) -> DataFrame:
    """Documents with the failure in its head: uniform noise on a share of them, the head missing, or turned against the others."""
    if failure is None or failure.kind == "query":
        return docs
    v = F.col(failure.head)
    if failure.kind == "missing":
        changed = F.lit(None).cast("array<double>")
    elif failure.kind == "conflicting":
        changed = conflicting(v, failure.amount)
    else:
        changed = F.when(unit(f"{seed}:f", F.col(key)) < failure.share, noisy(v, failure.amount, F.col(key))).otherwise(doubles(v))
    return docs.withColumn(failure.head, changed)


def failed_queries(queries: DataFrame, failure: Failure | None, key: str = "qid") -> DataFrame:
    """Queries with uniform noise in the failure's head, if it is one of queries."""
    if failure is None or failure.kind != "query":
        return queries
    return queries.withColumn(failure.head, noisy(F.col(failure.head), failure.amount, F.col(key)))


# ---- runs


def protocol(n_docs: int, full: int = 30, builds: int = 5, sessions: int = 6, query_only: int = 30) -> dict:
    """How often to build and query at a scale: every run anew to 100,000 documents, builds apart from sessions to a million, one build beyond."""
    if n_docs <= 100_000:
        return {"kind": "full", "builds": full, "query_runs": full}
    if n_docs <= 1_000_000:
        return {"kind": "split", "builds": builds, "query_runs": builds * sessions}
    return {"kind": "query_only", "builds": 1, "query_runs": query_only}


def warm_up(run: Callable[[], object], most: int = 100, stable: float = 0.05) -> dict:
    """Runs until the mean of ten, looked at every five, changes by less than `stable`; at most `most` times."""
    took: list[float] = []
    before = mean = 0.0
    for i in range(most):
        began = time.perf_counter()
        run()
        took.append((time.perf_counter() - began) * 1000)
        if i >= 10 and i % 5 == 0:
            mean = sum(took[-10:]) / 10
            if before > 0 and abs(mean - before) / before < stable:
                return {"runs": i + 1, "mean_ms": mean, "total_ms": sum(took)}
            before = mean
    return {"runs": len(took), "mean_ms": sum(took) / max(1, len(took)), "total_ms": sum(took)}


def verify_count(table: DataFrame, expected: int) -> None:
    """ValueError unless the table has that many rows: 0 before a run, all documents after loading."""
    n = table.count()
    if n != expected:
        raise ValueError(f"expected {expected} rows, found {n}")


class Checkpoint:
    """Which experiments are done, in a small file, so that a run can go on where it broke off."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/checkpoint"

    @staticmethod
    def name(system: str, dataset: str, scale: int, level: str) -> str:
        return f"{system}/{dataset}/{scale}@{level}"

    def done(self) -> list[str]:
        from mhr.sources import store

        versions = store.names(self.spark, self.path)
        return [x for x in store.get_text(self.spark, f"{self.path}/{versions[-1]}").split("\n") if x] if versions else []

    def save(self, experiment: str) -> None:
        from mhr.sources import store

        done = self.done()
        if experiment not in done:
            store.put_text(self.spark, f"{self.path}/{len(done) + 1:08}", "\n".join([*done, experiment]))

    def clear(self) -> None:
        from mhr.sources import store

        store.remove(self.spark, self.path)


DEFAULTS = {"dimension": 128, "warmup_runs": 10, "bootstrap_rounds": 1000, "confidence": 0.95, "output": "results", "scales": [2000], "systems": ["mhr"], "experiments": ["standard"], "concurrency": [1], "seconds": 10, "ef": [32, 64, 128], "queries": 100, "repeats": 1}


def config(path: str | None = None, **override) -> dict:
    """Settings of a benchmark: defaults, then a TOML file, then arguments; ValueError if they can't be."""
    out = dict(DEFAULTS)
    if path:
        with open(path, "rb") as f:
            out |= tomllib.load(f)
    out |= override
    rules: Mapping[str, bool] = {
        "dimension must be 64 to 4096": 64 <= out["dimension"] <= 4096,
        "warmup_runs must be positive": out["warmup_runs"] > 0,
        "bootstrap_rounds must be 100 at least": out["bootstrap_rounds"] >= 100,
        "confidence must be between 0 and 1": 0 < out["confidence"] < 1,
        "output must be named": bool(out["output"]),
        "scales must be 100 at least": bool(out["scales"]) and min(out["scales"]) >= 100,
        "a system must be named": bool(out["systems"]),
        "experiments must be known": bool(out["experiments"]) and set(out["experiments"]) <= set(EXPERIMENTS),
        "concurrency must be given": bool(out["concurrency"]),
        "seconds must be 10 at least": out["seconds"] >= 10,
        "ef must be given": bool(out["ef"]),
        "queries must be 100 at least": out["queries"] >= 100,
        "repeats must be positive": out["repeats"] >= 1,
    }
    for rule, kept in rules.items():
        if not kept:
            raise ValueError(rule)
    unknown = set(out) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return out
