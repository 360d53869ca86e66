"""Operator 10: mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact token length.  Each source gets weight * total tokens as its budget; one that has
less gives all it has, and the shortfall is reported, not made up by others nor taken from them.  A seeded
share of every length is taken first, leaving a margin; bounded-knapsack dynamic programming over the counts left then
fills the remaining budget exactly, or as nearly below it as the lengths allow.  Of each (source, length) the documents of
least seeded hash go in.  Only counts pass through Python, one source at a time; texts aren't shuffled, but for those of
repeated rows and where the thresholds are too many to broadcast.  A threshold is found by a histogram of the hashes' high
bits first, so no (source, length), however many documents it has, is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stored

#: Weight of a source: its tokens to this power, unless weights are given.
ALPHA, SEED = 0.7, 17
#: Token budget of the mixture as a share of all tokens, unless a number of tokens is given.
BUDGET = 1.0
#: Budget left to the dynamic programme: in largest lengths, and in tokens at most (longer documents are placed before it).
MARGIN, MARGIN_TOKENS = 4, 1 << 20
#: Documents of a (source, length) that are ranked together, about; thresholds or keys that are broadcast, at most.
RANKED, BROADCAST = 1 << 16, 200_000


def take_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their tokens come as near to `budget` as can be, never above.

    The first share is proportional and rounded down; what it leaves, at most the margin, is filled by bounded-knapsack
    dynamic programming over the lengths in ascending order.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    margin = min(MARGIN * int(lengths.max()), MARGIN_TOKENS)
    base = np.floor(counts * (max(0, budget - margin) / total)).astype(np.int64)
    rest = budget - int((lengths * base).sum())
    # Rounding down leaves up to one document of each length: give back whole documents, longest first, beyond the margin.
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= margin:
            break
        more = min(int(counts[i] - base[i]), (rest - margin) // max(1, int(lengths[i])))
        base[i] += more
        rest -= more * int(lengths[i])
    left = counts - base
    return base + knapsack(lengths, left, rest)


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: counts to take for the largest reachable total that is at most `budget`.

    One pass a length over the reachable sums: `used[s]` is how many of this length the first way to reach s needs, and the
    choice of each newly reached sum is kept, so the way back is exact.  Stops once the budget itself is reached.
    """
    take = np.zeros(len(lengths), np.int64)
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    by, many = np.full(budget + 1, -1, np.int32), np.zeros(budget + 1, np.int32)
    for i in np.argsort(lengths, kind="stable"):
        v, c = int(lengths[i]), int(counts[i])
        if v <= 0 or v > budget or c <= 0:
            continue
        if reach[budget]:
            break
        rows = -(-(budget + 1) // v)
        grid = np.zeros(rows * v, bool)
        grid[: budget + 1] = reach
        grid = grid.reshape(rows, v)
        row = np.arange(rows, dtype=np.int32)[:, None]
        last = np.where(grid, row, np.int32(-1))
        np.maximum.accumulate(last, axis=0, out=last)
        away = row - last
        fresh = (~grid & (last >= 0) & (away <= c)).reshape(-1)[: budget + 1]
        by[fresh], many[fresh] = i, away.reshape(-1)[: budget + 1][fresh]
        reach |= fresh
    s = int(np.flatnonzero(reach)[-1])
    while s > 0:
        take[by[s]] += many[s]
        s -= int(many[s]) * int(lengths[by[s]])
    zero = lengths == 0
    take[zero] = counts[zero]
    return take


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("len")
    take = take_counts(pdf["len"].to_numpy(), pdf["n"].to_numpy(), int(pdf["budget"].iloc[0]))
    return pdf.assign(take=take)[["src", "len", "n", "take", "budget", "shortfall"]]


def _key(text: Column, doc_id: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, text)


def budgets(counts: DataFrame, weights: Mapping[str, float] | None, total_tokens: int | None, alpha: float) -> DataFrame:
    """(src, tokens, weight, budget, shortfall): budget is weight * total tokens, total being BUDGET of all tokens unless given;
    shortfall is what the source lacks of it."""
    per = counts.groupBy("src").agg(F.sum(F.col("len") * F.col("n")).alias("tokens"))
    if weights is None:
        raw = F.pow(F.col("tokens").cast("double"), F.lit(alpha))
    else:
        raw = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]), F.coalesce("src", F.lit(""))), F.lit(0.0)) if weights else F.lit(0.0)
    per = stored(per.withColumn("raw", raw), "sources")
    tokens, weight = per.agg(F.sum("tokens"), F.sum("raw")).first()
    per = per.withColumn("weight", F.col("raw") / F.lit(float(weight)) if weight else F.lit(0.0))
    total = F.lit(total_tokens if total_tokens is not None else BUDGET * (tokens or 0))
    per = per.withColumn("budget", F.floor(F.col("weight") * total + F.lit(1e-6)).cast("bigint"))
    return per.select("src", "tokens", "weight", "budget", F.greatest(F.lit(0), F.col("budget") - F.col("tokens")).cast("bigint").alias("shortfall"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def thresholds(light: DataFrame, taken: DataFrame) -> DataFrame:
    """(src, len, upto, budget, shortfall): the take-th least key of each (src, len) of `light` (src, len, key)."""
    side = taken.select(F.col("src").alias("s"), F.col("len").alias("l"), "n", "take", "budget", "shortfall")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(RANKED)))).cast("int")
    rows = light.join(side, _same("src", "s") & (F.col("len") == F.col("l"))).withColumn("bits", bits)
    rows = rows.withColumn("high", F.expr("if(bits = 0, 0L, shiftright(key, 64 - bits))"))
    group = ["src", "len", "budget", "shortfall", "take"]
    cells = rows.groupBy(*group, "high").agg(F.count("*").alias("here"), F.max("key").alias("most"))
    up = F.sum("here").over(Window.partitionBy("src", "len").orderBy("high"))
    cells = stored(cells.withColumn("before", up - F.col("here")).where("before < take and before + here >= take"), "cells")
    whole = cells.where("before + here = take").select("src", "len", F.col("most").alias("upto"), "budget", "shortfall")
    part = cells.where("before + here > take").select(F.col("src").alias("s2"), F.col("len").alias("l2"), F.col("high").alias("h2"), "before")
    inside = rows.join(part, _same("src", "s2") & (F.col("len") == F.col("l2")) & (F.col("high") == F.col("h2")))
    ranked = inside.withColumn("rank", F.row_number().over(Window.partitionBy("src", "len").orderBy("key"))).where("before + rank = take")
    return whole.unionByName(ranked.select("src", "len", F.col("key").alias("upto"), "budget", "shortfall"))


def _chosen(flat: DataFrame, weights, total_tokens, alpha: float, seed: int) -> DataFrame:
    """The rows of `flat` (doc_id, text, src, ...) that go in, with len, budget and shortfall."""
    flat = flat.where("text is not null").withColumn("len", n_words(F.col("text"))).withColumn("key", _key(F.col("text"), F.col("doc_id"), seed))
    light = stored(flat.groupBy("src", "len", "key").agg(F.count("*").alias("copies")), "light")
    counts = light.groupBy("src", "len").agg(F.count("*").alias("n"))
    plan = counts.join(budgets(counts, weights, total_tokens, alpha).select(F.col("src").alias("of"), "budget", "shortfall"), _same("src", "of")).drop("of")
    taken = stored(plan.groupBy("src").applyInPandas(_fit, "src string, len bigint, n bigint, take bigint, budget bigint, shortfall bigint").where("take > 0"), "taken")
    limits = stored(thresholds(light.select("src", "len", "key"), taken).select(F.col("src").alias("s"), F.col("len").alias("l"), "upto", "budget", "shortfall"), "limits")
    out = flat.join(_small(limits), _same("src", "s") & (F.col("len") == F.col("l"))).where("key <= upto").drop("s", "l", "upto")
    again = light.where("copies > 1").select(F.col("src").alias("s"), F.col("key").alias("k"))
    if not again.isEmpty():  # of repeated rows one goes in; they alone are shuffled
        again = _small(stored(again.distinct(), "repeated"))
        same = _same("src", "s") & (F.col("key") == F.col("k"))
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates(["src", "key"]))
    return out


def _small(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= BROADCAST else side


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, total_tokens: int | None = None, alpha: float = ALPHA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, n_tokens, budget, shortfall) of the documents that make up the mixture; the last two are of the source.

    Without weights a source weighs its tokens to the power alpha; without a total the budget is BUDGET of all tokens.

    Tokens are words parted by white space.  Rows that repeat id, source and text are one document: counted once and returned
    once.  A null text is never chosen; an empty one has length 0, costs nothing and is chosen where its
    source has a budget plan.  A null source is a source of its own, named "" in `weights`; sources missing there have
    weight 0.  A budget above what a source has takes all of it, and
    the rest is its shortfall.  An empty table gives an empty result; other columns are
    ignored.  Runs jobs while the result is built.
    """
    flat = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("src"))
    return _chosen(flat, weights, total_tokens, alpha, seed).select("doc_id", F.col("src").alias("source"), F.col("len").alias("n_tokens"), "budget", "shortfall")


def mix_rows(docs: DataFrame, weights: Mapping[str, float] | None = None, total_tokens: int | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """The chosen rows of `docs` (as `mix_sources`) with all their columns."""
    at = {c: docs.columns.index(c) for c in ("doc_id", "text", "source")}
    tmp = [f"_c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*tmp).select("*", F.col(tmp[at["doc_id"]]).cast("bigint").alias("doc_id"), F.col(tmp[at["text"]]).cast("string").alias("text"), F.col(tmp[at["source"]]).cast("string").alias("src"))
    return _chosen(flat, weights, total_tokens, alpha, seed).select(*tmp).toDF(*docs.columns)


def brute_force(lengths: list[int], counts: list[int], budget: int) -> int:
    """Largest total of at most `budget`, by trying all; for tests."""
    sums = {0}
    for v, c in zip(lengths, counts):
        sums = {s + v * k for s in sums for k in range(c + 1) if s + v * k <= budget}
    return max(sums)
