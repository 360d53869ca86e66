"""Operator 5: exact top-k search by BM25 with MaxScore.

Every partition of the corpus is a shard.  It reads its documents block by block, makes postings of the query terms with
their score contributions, and for each query splits the terms by their bounds in the block: the non-essential ones, whose
bounds together stay below the k-th best score so far, are never traversed; documents of the essential postings are
candidates, and the other terms are probed, largest bound first, only while a candidate can still compete.  The shards'
lists are then merged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_text, split_words, text_chunks, words

TOP, K1, B = 10, 1.2, 0.75
#: Queries of one pass over the corpus (their terms are broadcast); bytes of a block.
QUERIES, BLOCK = 5_000, 4 << 20
EPS = 1e-6


@dataclass
class Plan:
    terms: np.ndarray  # sorted hashes
    queries: list[tuple[int, np.ndarray, np.ndarray]]  # id, term numbers, weights
    idf: np.ndarray
    mean: float


def _block(h: np.ndarray, ptr: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, doc, tf) of a block, by term and doc."""
    at = np.searchsorted(terms, h)
    at[at == len(terms)] = 0
    hit = np.flatnonzero(terms[at] == h)
    doc = np.searchsorted(ptr, hit, "right") - 1
    n = len(ptr) - 1
    code, tf = np.unique(at[hit] * n + doc, return_counts=True)
    return code // n, code % n, tf


def _statistics(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        df, docs, total = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for _, _, buf, offs in text_chunks(batch, "text", BLOCK):
                h, _, _, ptr = words(buf, offs)
                term, _, _ = _block(h, ptr, terms)
                df += np.bincount(term, minlength=len(terms))
                docs, total = docs + int((np.diff(ptr) > 0).sum()), total + len(h)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-2, -1], hit)), pa.array(np.append([docs, total], df[hit]))], ["term", "n"])

    return run


class Shard:
    """The best k of each query so far."""

    def __init__(self, plan: Plan, k: int):
        self.plan, self.k = plan, k
        self.best = [(np.empty(0), np.empty(0, np.int64))] * len(plan.queries)
        self.floor = np.full(len(plan.queries), -np.inf)

    def block(self, h: np.ndarray, ptr: np.ndarray, ids: np.ndarray) -> None:
        p = self.plan
        term, doc, tf = _block(h, ptr, p.terms)
        if not len(term):
            return
        gain = p.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.diff(ptr)[doc] / p.mean))
        lo, hi = np.searchsorted(term, np.arange(len(p.terms))), np.searchsorted(term, np.arange(len(p.terms)), "right")
        bound = np.zeros(len(p.terms))
        there = np.flatnonzero(hi > lo)
        bound[there] = np.maximum.reduceat(gain, lo[there])
        score = np.zeros(len(ids))
        for q, (_, own, weight) in enumerate(p.queries):
            most = bound[own] * weight
            order = np.argsort(most, kind="stable")
            order = order[most[order] > 0]
            below = np.cumsum(most[order])
            floor = self.floor[q] - EPS
            cut = int(np.searchsorted(below, floor))  # terms before it are non-essential
            if cut == len(order):
                continue
            parts = []
            for i in order[cut:]:
                a, b = lo[own[i]], hi[own[i]]
                parts.append(doc[a:b])
                score[doc[a:b]] += weight[i] * gain[a:b]
            cand = np.unique(np.concatenate(parts))
            seen = cand
            for r in range(cut - 1, -1, -1):
                cand = cand[score[cand] + below[r] >= floor]
                if not len(cand):
                    break
                i = order[r]
                a, b = lo[own[i]], hi[own[i]]
                at = np.searchsorted(doc[a:b], cand)
                at[at == b - a] = 0
                ok = doc[a + at] == cand
                score[cand[ok]] += weight[i] * gain[a + at[ok]]
            cand = cand[score[cand] >= floor]
            if len(cand):
                s, d = np.append(self.best[q][0], np.round(score[cand], 6)), np.append(self.best[q][1], ids[cand])
                top = np.lexsort((d, -s))[: self.k]
                self.best[q] = s[top], d[top]
                if len(top) == self.k:
                    self.floor[q] = s[top[-1]]
            score[seen] = 0


def _searched(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(shared.value, k)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in text_chunks(batch, "text", BLOCK):
                h, _, _, ptr = words(buf, offs)
                shard.block(h, ptr, ids[lo:hi])
        n = [len(s) for s, _ in shard.best]
        qid = np.repeat(np.array([q for q, *_ in shared.value.queries], np.int64), n)
        yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(np.concatenate([d for _, d in shard.best] or [np.empty(0, np.int64)]).astype(np.int64)), pa.array(np.concatenate([s for s, _ in shard.best] or [np.empty(0)]))], ["query_id", "doc_id", "score"])

    return run


def top_k(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query by BM25 (k1 1.2, b 0.75), exactly.

    Score is rounded to 6 places; ties go to the smaller doc_id.  A term of the query counts as often as it stands there.
    Statistics cover all documents with a word.  Documents without a query term are never listed; null ids and null or
    wordless texts are left out on both sides; repeated rows are documents of their own, and a repeated query id has the
    texts of its rows joined.  Empty tables give an empty result; other columns are ignored.

    Made for up to some ten thousand queries: each QUERIES of them take a pass over the corpus, their texts are collected and
    their terms broadcast, and a task sends k rows a query.  Runs jobs while the result is built.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col(query_id).cast("bigint").alias("q"), F.col(query_text).cast("string").alias("t")).where("q is not null and t is not null")
    asked = asked.groupBy("q").agg(F.array_join(F.sort_array(F.collect_list("t")), " ").alias("t"))
    corpus = keyed_text(docs, id_col, text_col).where("doc_id is not null and text is not null")
    n = asked.count()
    parts = max(1, -(-n // QUERIES))
    out = None
    for part in range(parts):  # a pass over the corpus for so many queries
        mine = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part)
        one = _one_pass(corpus, {r.q: r.t for r in mine.collect()}, k)
        out = one if out is None else out.unionByName(one)
    best = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score")


def _one_pass(corpus: DataFrame, texts: dict[int, str], k: int) -> DataFrame:
    sc = corpus.sparkSession.sparkContext
    bags = {q: _bag(t) for q, t in sorted(texts.items())}
    terms = np.array(sorted({t for b in bags.values() for t in b}), np.uint64)
    if not len(terms):
        return corpus.sparkSession.createDataFrame([], "query_id bigint, doc_id bigint, score double")
    counts = {r[0]: r[1] for r in corpus.mapInArrow(_statistics(sc.broadcast(terms)), "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect()}  # as many rows as terms
    docs, total = counts.pop(-2, 0), counts.pop(-1, 0)
    df = np.array([counts.get(i, 0) for i in range(len(terms))], float)
    plan = Plan(terms, [(q, np.searchsorted(terms, np.array(sorted(b), np.uint64)), np.array([b[t] for t in sorted(b)], float)) for q, b in bags.items() if b], np.log(1 + (docs - df + 0.5) / (df + 0.5)), total / max(1, docs))
    return corpus.mapInArrow(_searched(sc.broadcast(plan), k), "query_id bigint, doc_id bigint, score double")


def _bag(text: str) -> Counter:
    from .common import hash_of

    return Counter(hash_of(w) for w in split_words(text))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
q AS (SELECT item_id, term, count(*) AS weight FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
r AS (SELECT item_id AS query_id, doc_id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
      FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r
QUALIFY rank <= 10
"""
