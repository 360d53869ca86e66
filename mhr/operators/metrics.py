"""Ranking quality, latency and statistics, as aggregations over result tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mhr.functions.vectors import euclidean
from mhr.sources.shared import numbered, stored


def quality(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(qid, recall, mrr, ndcg, ndcg_graded, precision) of the k best; relevant: (qid, doc_num, grade >= 1).

    A query with relevant documents but no result scores 0.
    """
    hits = results.where(F.col("rank") <= k).join(relevant, ["qid", "doc_num"], "left")
    disc = F.log2(F.col("rank") + 1)
    best = relevant.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "doc_num")))
    ideal = best.groupBy("qid").agg(F.count("*").alias("all"), F.sum(F.when(F.col("rank") <= k, 1.0 / disc).otherwise(0.0)).alias("idcg"), F.sum(F.when(F.col("rank") <= k, (F.pow(F.lit(2.0), F.col("grade")) - 1) / disc).otherwise(0.0)).alias("igdcg"))
    return _measures(hits, ideal, k)


def _measures(hits: DataFrame, ideal: DataFrame, k: int) -> DataFrame:
    """hits: (qid, rank, grade or null); ideal: (qid, all, idcg, igdcg)."""
    disc = F.log2(F.col("rank") + 1)
    rel = F.when(F.col("grade") > 0, 1.0).otherwise(0.0)
    per = hits.groupBy("qid").agg(F.sum(rel).alias("hits"), F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"), F.sum(rel / disc).alias("dcg"), F.sum((F.pow(F.lit(2.0), F.coalesce("grade", F.lit(0))) - 1) / disc).alias("gdcg"))
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9)
    return ideal.join(per, "qid", "left").select(
        "qid", z(F.col("hits") / F.col("all")).alias("recall"), z(1.0 / F.col("first")).alias("mrr"), z(F.least(F.lit(1.0), F.try_divide("dcg", "idcg"))).alias("ndcg"), z(F.least(F.lit(1.0), F.try_divide("gdcg", "igdcg"))).alias("ndcg_graded"), z(F.col("hits") / k).alias("precision")
    )


def quality_by_class(results: DataFrame, ids: DataFrame, k: int, within: int = 0) -> DataFrame:
    """`quality` where the relevant documents are all others (id, label) of the query's label, graded 2 if their ids are at most
    `within` apart, else 1.  Relevant ones are counted, not listed: pairs of a label would grow as its square."""
    own = ids.dropna().groupBy("id", "label").agg(F.count("*").alias("c"))
    near = own.select("label", F.explode(F.sequence(F.col("id") - within, F.col("id") + within)).alias("id"), F.col("id").alias("qid")).where("id <> qid").join(own, ["label", "id"]).groupBy("label", "qid").agg(F.sum("c").alias("near"))
    size = own.groupBy("label").agg(F.sum("c").alias("n"))
    each = own.withColumnRenamed("id", "qid").join(size, "label").join(near, ["label", "qid"], "left")
    counts = each.groupBy("qid").agg(F.sum(F.col("c") * (F.col("n") - F.col("c"))).alias("all"), F.sum(F.col("c") * F.coalesce("near", F.lit(0))).alias("two")).where(F.col("all") > 0)
    gain = lambda first, last: F.coalesce(F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: (i > first) & (i <= last)), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1)), F.lit(0.0))
    ideal = counts.select("qid", "all", gain(F.lit(0), F.col("all")).alias("idcg"), (3 * gain(F.lit(0), F.col("two")) + gain(F.col("two"), F.col("all"))).alias("igdcg"))
    labels = ids.dropna().groupBy("id").agg(F.collect_list("label").alias("l"))
    both = results.where(F.col("rank") <= k).join(labels.select(F.col("id").alias("qid"), F.col("l").alias("ql")), "qid", "left").join(labels.select(F.col("id").alias("doc_num"), F.col("l").alias("dl")), "doc_num", "left")
    times = F.when(F.col("qid") != F.col("doc_num"), F.aggregate("ql", F.lit(0), lambda s, x: s + F.size(F.filter("dl", lambda y: x == y))))
    grade = F.when(times > 0, F.when(F.abs(F.col("qid") - F.col("doc_num")) <= within, 2).otherwise(1))
    return _measures(both.select("qid", "rank", F.explode(F.array_repeat(grade, F.greatest(F.lit(1), times))).alias("grade")), ideal, k)


#: Rank error of the sketch that narrows a quantile down, as a share of the rows.
ACCURACY = 10_000


def quantiles(samples: DataFrame, value: str, wanted: Sequence[float], *by: str, nearest: bool = False) -> DataFrame:
    """(by, q, x): exact quantiles by linear interpolation, or the sample at the rounded place q * (n - 1).

    A sketch bounds where each lies; what is below is counted, and only values inside the bounds, pre-aggregated, are put in
    order.  So no group is sorted or held in one task, and a value that many rows share is one row.  Null values don't count.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    x = samples.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("v"))
    edges = [e for q in wanted for e in (max(0.0, q - 3 / ACCURACY), min(1.0, q + 3 / ACCURACY))]
    bounds = x.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v", F.array(*map(F.lit, edges)), ACCURACY).alias("e"))
    everything = F.array(*[F.lit(float(x)) for _ in wanted for x in ("-inf", "inf")])  # few rows: ranks are closer than the sketch tells
    bounds = bounds.withColumn("e", F.when(F.col("n") <= 4 * ACCURACY, everything).otherwise(F.col("e")))
    bounds = stored(bounds.withColumns({f"_j{i}": F.col(k) for i, k in enumerate(keys)}).drop(*keys), "bounds")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_j{i}"))
    rows = x.join(bounds, same) if keys else x.crossJoin(F.broadcast(bounds))  # one row
    below = rows.groupBy(*keys, "n").agg(F.array(*[F.sum((F.col("v") < F.col("e")[2 * i]).cast("bigint")) for i in range(len(wanted))]).alias("below"))
    inside = rows.select(*keys, "v", F.explode(F.array_compact(F.array(*[F.when(F.col("v").between(F.col("e")[2 * i], F.col("e")[2 * i + 1]), i) for i in range(len(wanted))]))).alias("i")).groupBy(*keys, "i", "v").agg(F.count("*").alias("c"))
    below = below.withColumnsRenamed({k: f"_j{i}" for i, k in enumerate(keys)})
    cells = inside.join(below, same) if keys else inside.crossJoin(F.broadcast(below))
    upto = F.sum("c").over(Window.partitionBy(*keys, "i").orderBy("v")) + F.col("below")[F.col("i")]
    q = F.element_at(F.array(*map(F.lit, map(float, wanted))), F.col("i") + 1)
    cells = cells.withColumn("upto", upto).withColumn("q", q).withColumn("at", F.col("q") * (F.col("n") - 1))
    holds = lambda place: (F.col("upto") > place) & (F.col("upto") - F.col("c") <= place)
    pick = lambda place: F.max(F.when(holds(place), F.col("v")))
    if nearest:
        out = cells.groupBy(*keys, "q").agg(pick(F.floor(F.col("at") + 0.5)).alias("x"))
    else:
        two = cells.groupBy(*keys, "q").agg(pick(F.floor("at")).alias("lo"), pick(F.ceil("at")).alias("hi"), F.max(F.col("at") - F.floor("at")).alias("part"))
        out = two.withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part"))
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "q", "x")


def latency_summary(samples: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, least, most and percentiles by linear interpolation."""
    names = {0.5: "p50", 0.9: "p90", 0.95: "p95", 0.99: "p99", 0.999: "p999"}
    q = quantiles(samples, value, list(names), *by)
    wide = q.groupBy(*by).agg(*[F.round(F.max(F.when(F.col("q") == p, F.col("x"))), 6).alias(n) for p, n in names.items()])
    base = samples.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    if not by:
        return base.crossJoin(F.broadcast(wide))  # a row each
    wide = wide.withColumnsRenamed({c: f"_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return base.join(wide, same, "left").select(*by, "mean", "least", "most", *names.values())


def nearest_rank(samples: DataFrame, value: str, q: float, *by: str) -> DataFrame:
    """The sample at the rounded place q * (n - 1)."""
    return quantiles(samples, value, [q], *by, nearest=True).select(*by, F.col("x").alias("value"))


def overhead_removed(samples: DataFrame, value: str, null_p50: float, least: float = 0.001) -> DataFrame:
    return samples.withColumn("net", F.greatest(F.col(value) - null_p50, F.lit(least)))


def calibrated(samples: DataFrame, null_samples: DataFrame, value: str, least: float = 0.001) -> DataFrame:
    """Adds net: the samples less the median of queries that do nothing."""
    p50 = quantiles(null_samples, value, [0.5]).first()
    return overhead_removed(samples, value, p50.x if p50 else 0.0, least)


def saturation(samples: DataFrame, level: str, value: str) -> DataFrame:
    """One row (concurrency, qps): the level of the best mean throughput (ties: the lower)."""
    t = samples.groupBy(F.col(level).alias("concurrency")).agg(F.avg(value).alias("qps"))
    best = t.agg(F.max_by(F.struct("concurrency", "qps"), F.struct("qps", -F.col("concurrency"))).alias("r"))
    return best.select("r.concurrency", F.round("r.qps", 6).alias("qps"))


def consensus(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Mean size of the intersection of two top-k lists (a count, as defined)."""
    side = lambda x, n: x.select("qid", "doc_num", *[F.when(F.col("rank") <= k, 1 if m == n else 0).otherwise(0).alias(m) for m in "ab"])  # noqa: E731 - either list is read once
    both = side(a, "a").unionByName(side(b, "b")).groupBy("qid", "doc_num").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return both.groupBy("qid").agg(F.sum(F.col("a") * F.col("b")).alias("count")).agg(F.round(F.avg("count"), 6).alias("consensus"))


def gating_efficiency(gated: DataFrame, uniform: DataFrame, key: str = "qid", measure: str = "ndcg") -> DataFrame:
    """(key, efficiency): what gating gains over uniform weights, as a share of the latter; 0 where that has nothing."""
    both = gated.select(key, F.col(measure).alias("_g")).join(uniform.select(key, F.col(measure).alias("_u")), key)
    return both.select(key, F.round(F.when(F.col("_u") < 1e-15, 0.0).otherwise(F.try_divide(F.col("_g") - F.col("_u"), "_u")), 9).alias("efficiency"))


def pareto_qps(points: DataFrame, target: float, *by: str) -> DataFrame:
    """Queries a second at a recall, interpolated between neighbouring points (recall, qps)."""
    w = Window.partitionBy(*by).orderBy("recall", "qps")
    nxt = points.withColumn("r2", F.lead("recall").over(w)).withColumn("q2", F.lead("qps").over(w))
    at = F.col("qps") + (F.col("q2") - F.col("qps")) * F.try_divide(F.lit(target) - F.col("recall"), F.col("r2") - F.col("recall"))
    return nxt.where((F.col("recall") <= target) & (F.col("r2") >= target) & (F.col("r2") > F.col("recall"))).groupBy(*by).agg(F.round(F.max(at), 6).alias("qps"))


def dominance(points: DataFrame, system: str, targets: Sequence[float] = (0.9, 0.95, 0.99)) -> DataFrame:
    """(a, b, dominates) for every two systems: whether a reaches every target recall, with no fewer queries a second than b where b does."""
    every, out = points.select(system).distinct(), None
    for t in targets:
        one = every.join(pareto_qps(points, t, system), system, "left").withColumn("target", F.lit(float(t)))
        out = one if out is None else out.unionByName(one)
    out = stored(out, "pareto")  # a row a system and target
    a, b = (out.select(F.col(system).alias(s), F.col("qps").alias(f"q{s}"), "target") for s in "ab")
    j = a.join(b, "target").where("a <> b")
    return j.groupBy("a", "b").agg(F.bool_and(F.coalesce(F.col("qa") >= F.col("qb"), F.col("qa").isNotNull() & F.col("qb").isNull())).alias("dominates"))


def moments(samples: DataFrame, value: str, *by: str) -> DataFrame:
    return samples.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var"))


@F.pandas_udf(DoubleType())
def t_p_values(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t; null where either is."""
    return pd.Series([None if pd.isna(x) or pd.isna(d) else t_p_value(float(x), float(d)) for x, d in zip(t, df)], dtype="float64")


def _compared(j: DataFrame) -> DataFrame:
    """t, df, p and cohen_d of rows with moments n, m and v of a and b."""
    sa, sb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / (F.col("n_a") + F.col("n_b") - 2))
    raw = j.withColumn("t", F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt(sa + sb))).withColumn("df", F.try_divide((sa + sb) * (sa + sb), sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1)))
    return raw.select("a", "b", F.round("t", 6).alias("t"), F.round("df", 3).alias("df"), F.round(t_p_values("t", "df"), 9).alias("p"), F.round(F.try_divide(F.abs(F.col("m_a") - F.col("m_b")), pooled), 6).alias("cohen_d"))


def _sides(samples: DataFrame, value: str, by: str) -> tuple[DataFrame, DataFrame]:
    m = moments(samples, value, by)
    return tuple(m.select(F.col(by).alias(s), F.col("n").alias(f"n_{s}"), F.col("mean").alias(f"m_{s}"), F.col("var").alias(f"v_{s}")) for s in "ab")


def welch(samples: DataFrame, value: str, by: str) -> DataFrame:
    """(a, b, t, df, p, cohen_d) for every two groups, a before b."""
    a, b = _sides(samples, value, by)
    return _compared(a.join(b, F.col("a") < F.col("b")))


def compare_to_all(samples: DataFrame, value: str, by: str, target, fdr: float = 0.05) -> DataFrame:
    """(b, t, df, p, cohen_d, q, rejected): Welch tests of the group `target` against every other, corrected together."""
    a, b = _sides(samples, value, by)
    tests = stored(_compared(a.where(F.col("a") == target).crossJoin(b.where(F.col("b") != target))).drop("a"), "tests")  # one row on the left
    return tests.join(benjamini_hochberg(tests, "p", "b", fdr).drop("p"), "b")


def benjamini_hochberg(tests: DataFrame, p: str, key: str, fdr: float = 0.05) -> DataFrame:
    """(key, p, q, rejected): least p * m / rank of this and all later ranks, 1 at most.

    Ranks are by range partitions, and the least of all later parts is one number a part, so no task sees all tests.
    """
    r = numbered(tests.select(key, F.col(p).alias("p")), "p", key)
    m = r.count()
    r = r.withColumn("x", F.least(F.lit(1.0), F.col("p") * m / (F.col("_n") + 1)))
    later, least = [], 1.0
    for part, x in sorted(r.groupBy("_p").agg(F.min("x")).collect(), reverse=True):  # one row a part
        later.append((part, least))
        least = min(least, x)
    behind = r.sparkSession.createDataFrame(later, "_p int, _later double")
    here = F.min("x").over(Window.partitionBy("_p").orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0))
    q = r.join(F.broadcast(behind), "_p").withColumn("q", F.round(F.least(here, "_later"), 9))
    return q.select(key, "p", "q", (F.col("q") <= fdr).alias("rejected"))


def hubness(neighbours: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: skewness of how often each document is a neighbour, hubs (2 * mean or more), antihubs (below 0.5)."""
    c = docs.select("doc_num").join(neighbours.groupBy("doc_num").agg(F.count("*").alias("c")), "doc_num", "left").select(F.coalesce("c", F.lit(0)).cast("double").alias("c"))
    m = c.agg(F.avg("c").alias("m"), F.stddev_samp("c").alias("s"))
    j = c.crossJoin(F.broadcast(m))  # one row
    return j.agg(F.round(F.avg(F.pow(F.try_divide(F.col("c") - F.col("m"), F.col("s")), 3)), 6).alias("skewness"), F.sum((F.col("c") >= 2 * F.col("m")).cast("bigint")).alias("hubs"), F.sum((F.col("c") < 0.5).cast("bigint")).alias("antihubs"))


def local_dimension(neighbours: DataFrame, distance: str = "distance") -> DataFrame:
    """(qid, lid): -(k-1) / sum of ln(r_i / r_k) over the nearer ones; k where all are as far."""
    far = F.max(distance).over(Window.partitionBy("qid"))
    logs = neighbours.withColumn("far", far).groupBy("qid").agg(F.count("*").alias("k"), F.sum(F.when(F.col(distance) > 0, F.log(F.col(distance) / F.col("far"))).otherwise(0.0)).alias("s"))
    return logs.select("qid", F.round(F.when(F.col("s") < 0, -(F.col("k") - 1) / F.col("s")).otherwise(F.col("k").cast("double")), 6).alias("lid"))


def contrast(neighbours: DataFrame) -> DataFrame:
    """(qid, gap, unambiguous): whether the best score leads the second by more than .05."""
    g = neighbours.groupBy("qid").agg((F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.max(F.when(F.col("rank") == 2, F.col("score")))).alias("gap"))
    return g.select("qid", F.round("gap", 9).alias("gap"), (F.col("gap") > 0.05).alias("unambiguous"))


def contrast_ratio(queries: DataFrame, docs: DataFrame, truth: DataFrame, vec: str = "vec") -> DataFrame:
    """One row (contrast_ratio): mean distance of queries to their true nearest, over that to documents paired by hash; .5 if either lacks.

    queries (qid, vec), docs (doc_num, vec), truth (qid, doc_num) the first of each.  A query's other document is the one
    that follows it in the order of a digest, so that every run has the same pairs.
    """
    q = queries.select("qid", F.col(vec).alias("_q"))
    near = q.join(truth.select("qid", "doc_num"), "qid").join(docs.select("doc_num", F.col(vec).alias("_d")), "doc_num")
    place = lambda c: F.md5(F.col(c).cast("string").cast("binary"))
    ring = numbered(docs.where(F.col(vec).isNotNull()).select("doc_num", F.col(vec).alias("_d"), place("doc_num").alias("_h")), "_h", "doc_num")
    n = ring.count()
    other = numbered(q.withColumn("_h", place("qid")), "_h", "qid").withColumn("_n", F.pmod(F.col("_n") + 1, F.lit(max(1, n)))).drop("_p").join(ring.select("_n", "_d"), "_n")
    mean = lambda df: df.agg(F.avg(euclidean(F.col("_q"), F.col("_d")))).first()[0]
    a, b = mean(near), mean(other)
    ratio = 0.5 if a is None or b is None or b < 1e-15 else a / b
    return docs.sparkSession.createDataFrame([(round(ratio, 6),)], "contrast_ratio double")


def measured_difficulty(queries: DataFrame, docs: DataFrame, k: int = 10, vec: str = "vec") -> DataFrame:
    """One row: contrast_ratio, mean_lid and std_lid (of documents, themselves left out), hubness_skewness, unambiguous share of queries."""
    from .search import knn

    asking = docs.select(F.col("doc_num").alias("qid"), vec)
    near = stored(knn(docs, asking, k + 1, "l2", vec), "near")
    lids = local_dimension(ranked_without(near, k).withColumn("distance", -F.col("score"))).agg(F.round(F.avg("lid"), 6).alias("mean_lid"), F.round(F.stddev_pop("lid"), 6).alias("std_lid"))
    skew = hubness(near.where(F.col("rank") <= k), docs).select(F.col("skewness").alias("hubness_skewness"))
    best = stored(knn(docs, queries, 2, "cosine", vec), "best")
    clear = contrast(best).agg(F.round(F.avg(F.coalesce("unambiguous", F.lit(True)).cast("double")), 6).alias("unambiguous_top1"))
    ratio = contrast_ratio(queries, docs, best.where("rank = 1"), vec)
    return ratio.crossJoin(lids).crossJoin(skew).crossJoin(clear)  # a row each


def ranked_without(near: DataFrame, k: int) -> DataFrame:
    """The k nearest others: a vector itself, and what it pushed beyond, left out."""
    others = near.where("qid <> doc_num")
    return others.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("rank") <= k)


def aggregate(samples: DataFrame, value: str, *by: str, level: float = 0.95) -> DataFrame:
    """(by, n, mean, std, low, high): mean and deviation of each group, with Student's interval."""

    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        return n.map({x: t_quantile(0.5 + level / 2, x - 1) if x > 1 else 0.0 for x in set(n)})

    m = moments(samples, value, *by).withColumn("half", F.coalesce(quantile("n") * F.sqrt(F.try_divide("var", "n")), F.lit(0.0)))
    return m.select(*by, "n", F.round("mean", 6).alias("mean"), F.round(F.sqrt("var"), 6).alias("std"), F.round(F.col("mean") - F.col("half"), 6).alias("low"), F.round(F.col("mean") + F.col("half"), 6).alias("high"))


def aggregate_quality(runs: DataFrame, measures: Sequence[str], level: float = 0.95, rounds: int = 1000) -> DataFrame:
    """(measure, n, mean, std, low, high, boot_low, boot_high) of each measure, a column of `runs`."""
    long = runs.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures])).alias("r")).select("r.*")
    boot = None
    for m in measures:
        one = bootstrap_interval(runs, m, rounds, level).select(F.lit(m).alias("measure"), F.round("low", 6).alias("boot_low"), F.round("high", 6).alias("boot_high"))
        boot = one if boot is None else boot.unionByName(one)
    return aggregate(long, "x", "measure", level=level).join(boot, "measure")


# ---- distributions (driver, plain Python)


def _beta_cf(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d or 1e-300), 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def t_p_value(t: float, df: float) -> float:
    """Two-sided."""
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_p_value(mid, df) / 2 < p else (lo, mid)
    return hi


def confidence_interval(samples: DataFrame, value: str, level: float = 0.95) -> tuple[float, float, float]:
    """(mean, low, high) by Student's t."""
    r = moments(samples, value).first()
    half = t_quantile(0.5 + level / 2, r.n - 1) * math.sqrt(r["var"] / r.n) if r.n > 1 else 0.0
    return r["mean"], r["mean"] - half, r["mean"] + half


def _resampled(samples: DataFrame, value: str, rounds: int, seed: int) -> DataFrame:
    """(i, m): means of Poisson resamples.  A task draws weights from hashes of its rows' places and sums them; it sends a row
    a round, so rows aren't multiplied."""
    x = samples.select(F.col(value).cast("double").alias("x")).where("x is not null").select("x", F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, term, total = [], math.exp(-1), 0.0
        for n in range(12):
            total += term
            edges.append(total)
            term /= n + 1
        salt = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sums, counts = np.zeros(rounds), np.zeros(rounds)
        for b in batches:
            values, hashes = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            for lo in range(0, len(values), 512):
                u = hashes[lo : lo + 512, None] + salt
                u = (u ^ (u >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                u = (u ^ (u >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                w = np.searchsorted(edges, (u ^ (u >> np.uint64(31))) / float(1 << 64), "right")
                sums, counts = sums + values[lo : lo + 512] @ w, counts + w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds)), pa.array(sums), pa.array(counts)], ["i", "s", "c"])

    return x.mapInArrow(run, "i bigint, s double, c double").groupBy("i").agg(F.try_divide(F.sum("s"), F.sum("c")).alias("m"))


def bootstrap_interval(samples: DataFrame, value: str, rounds: int = 1000, level: float = 0.95) -> DataFrame:
    """One row (low, high): percentiles of means of Poisson resamples, weights seeded by the rows' places."""
    return _resampled(samples, value, rounds, 1).agg(F.percentile("m", F.lit((1 - level) / 2)).alias("low"), F.percentile("m", F.lit((1 + level) / 2)).alias("high"))  # a row a round


def bootstrap_difference(a: DataFrame, b: DataFrame, value: str, rounds: int = 1000, level: float = 0.95) -> DataFrame:
    """One row (difference, low, high, std_error) of the means of two tables."""
    d = _resampled(a, value, rounds, 1).join(_resampled(b, value, rounds, 2).withColumnRenamed("m", "m2"), "i").select((F.col("m") - F.col("m2")).alias("d"))
    means = a.agg(F.avg(value).alias("x")).crossJoin(b.agg(F.avg(value).alias("y"))).select((F.col("x") - F.col("y")).alias("difference"))
    return means.crossJoin(d.agg(F.percentile("d", F.lit((1 - level) / 2)).alias("low"), F.percentile("d", F.lit((1 + level) / 2)).alias("high"), F.stddev_samp("d").alias("std_error")))


def sample_size(effect: float, alpha: float = 0.05, power: float = 0.8, comparisons: int = 1) -> int:
    """Runs a side; Bonferroni-corrected."""
    z = NormalDist().inv_cdf
    return math.ceil(2 * ((z(1 - alpha / comparisons / 2) + z(power)) / effect) ** 2)
