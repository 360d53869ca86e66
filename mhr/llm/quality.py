"""Operator 7: quality classifier.  Random-indexing word vectors, pooled per document, feed a two-layer numpy network
whose probabilities are calibrated by a temperature.

Tokens are words (case folded), runs of punctuation, and two markers: a word that repeats the one before it, and a word
in capitals.  Each hashed token has a sparse ternary index vector; its word vector is the sum of the index vectors of the
tokens around it in all documents: one distributed pass, whose tasks send sums of whole numbers, so that their order doesn't
matter.  A document is the mean of its tokens' vectors, over its whole text.  Only the network is fitted on a sample.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, keyed_text, mix, text_chunks, words

#: Labelled rows to fit the network on, of each class: the documented bound of the sample.
FIT_ROWS = 1500
WIDTH, NONZERO, WINDOW, HIDDEN, THRESHOLD = 32, 6, 2, 24, 0.5
#: Buckets of tokens: SPREAD * sqrt(rows), as a vocabulary grows, as a power of two between these; the broadcast is 64 bytes each.
SPREAD, LEAST, MOST = 512, 1 << 14, 1 << 20
PRIOR = 12.0
#: Tokens and bytes of text worked on at a time, to bound memory; buckets of a block of sums that is sent.
BLOCK, BYTES, PART = 1 << 15, 1 << 18, 1 << 12

_LEXICAL = np.zeros(256, bool)
_LEXICAL[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SYMBOL = ~_LEXICAL
_SYMBOL[[*range(9, 14), 32, 0]] = False
_FOLDED = BYTE.copy()
_FOLDED[65:91] = BYTE[97:123]
_AGAIN, _CAPS = 0, 1


def tokens(buf: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the tokens of all texts in order, and ptr: those of text i are ptr[i]:ptr[i+1]."""
    w, ws, we, wp = words(buf, offs, _LEXICAL, _FOLDED)
    s, ss, _, _ = words(buf, offs, _SYMBOL)
    bucket = lambda h: (h % np.uint64(buckets - 2)).astype(np.int64) + 2
    upper = np.append(0, np.cumsum((buf >= 65) & (buf <= 90), dtype=np.int32))
    lower = np.append(0, np.cumsum((buf >= 97) & (buf <= 122), dtype=np.int32))
    caps = (upper[we] - upper[ws] >= 2) & (lower[we] == lower[ws])
    again = np.zeros(len(w), bool)
    again[1:] = w[1:] == w[:-1]
    again[wp[:-1][wp[:-1] < len(w)]] = False
    at = np.concatenate([ws * 3, ss * 3, ws[caps] * 3 + 1, ws[again] * 3 + 2])
    b = np.concatenate([bucket(w), bucket(mix(s + np.uint64(1))), np.full(caps.sum(), _CAPS), np.full(again.sum(), _AGAIN)])
    order = np.argsort(at, kind="stable")
    return b[order], np.searchsorted(at[order], offs * 3)


def index_entries(b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Column and sign of the k-th of the NONZERO entries of each bucket's ternary index vector."""
    h = mix(b.astype(np.uint64) * np.uint64(8) + np.uint64(k + 1))
    return (h % np.uint64(WIDTH)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1)


def neighbour_sums(b: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that occur, sums): the index vectors of tokens within WINDOW of each, a neighbour at distance d weighing WINDOW // d."""
    if not len(b):
        return b, np.zeros((0, WIDTH), np.int64)
    order = np.argsort(b, kind="stable")
    edge = np.flatnonzero(np.append(True, b[order][1:] != b[order][:-1]))
    seen = b[order][edge]
    index = np.zeros((len(seen), WIDTH), np.int16)
    for k in range(NONZERO):
        column, sign = index_entries(seen, k)
        index[np.arange(len(seen)), column] += sign.astype(np.int16)
    local = np.empty(len(b), np.int64)
    local[order] = np.repeat(np.arange(len(seen)), np.diff(np.append(edge, len(b))))
    at = np.arange(len(b)) + WINDOW * (1 + np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)))  # WINDOW blanks between texts
    x = np.zeros((at[-1] + 1 + WINDOW, WIDTH), np.int16)
    x[at] = index[local]
    around = np.zeros_like(x)
    for d in range(1, WINDOW + 1):
        w = np.int16(WINDOW // d)
        around[d:] += x[:-d] * w
        around[:-d] += x[d:] * w
    return seen, np.add.reduceat(around[at[order]], edge, axis=0, dtype=np.int64)


def _summed(buckets: int):
    """Blocks of PART buckets' sums over the texts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((buckets, WIDTH), np.int32)
        for batch in batches:
            for _, _, buf, offs in text_chunks(batch, "text", BYTES, False):
                b, ptr = tokens(buf, offs, buckets)
                lo, n = 0, len(ptr) - 1
                while lo < n:  # as many texts as have about BLOCK tokens; of a longer one a block at a time, with WINDOW tokens of the next
                    hi = max(lo + 1, int(np.searchsorted(ptr, ptr[lo] + BLOCK, "right")) - 1)
                    for start in range(ptr[lo], ptr[hi], BLOCK) if hi == lo + 1 else (ptr[lo],):
                        if hi > lo + 1:
                            seen, sums = neighbour_sums(b[ptr[lo] : ptr[hi]], ptr[lo : hi + 1] - ptr[lo])
                            total[seen] += sums
                        else:
                            own = b[start : min(start + BLOCK + WINDOW, ptr[hi])]
                            seen, sums = neighbour_sums(own, np.array([0, len(own)]))
                            total[seen] += sums
                            if start + BLOCK < ptr[hi]:  # pairs inside the tokens that the next block has too count once
                                seen, sums = neighbour_sums(own[BLOCK:], np.array([0, len(own) - BLOCK]))
                                total[seen] -= sums
                    lo = hi
        for i in range(0, buckets, PART):
            if total[i : i + PART].any():
                yield _blocks([i], [total[i : i + PART]])

    return run


def _blocks(parts: list[int], sums: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums], pa.binary())], ["part", "sums"])


#: Sums of a task are whole numbers of 32 bits, the merged ones of 64.
def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(zlib.decompress(data), np.int32)
            total[part] = total[part] + x if part in total else x.astype(np.int64)
    yield _blocks(list(total), list(total.values()))


def word_vectors(docs: DataFrame, buckets: int) -> np.ndarray:
    """Unit vectors of all buckets over all texts of `docs` (text); zero for those that never occur."""
    blocks = docs.select("text").where("text is not null").mapInArrow(_summed(buckets), "part bigint, sums binary")
    blocks = blocks.repartition(min(16, max(1, buckets // PART)), "part").mapInArrow(_merged, "part bigint, sums binary")
    out = np.zeros((buckets, WIDTH), np.float32)
    for part, data in blocks.collect():  # at most `buckets` sums
        x = np.frombuffer(zlib.decompress(data), np.int64).reshape(-1, WIDTH)
        out[part : part + len(x)] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return out.astype(np.float16)


def buckets_for(rows: int) -> int:
    return min(MOST, max(LEAST, 1 << int(np.ceil(np.log2(SPREAD * max(1, rows) ** 0.5)))))


def pooled(vectors: np.ndarray, prior: np.ndarray, b: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Mean token vector of each text, with PRIOR tokens of the prior vector added, so that few words say little."""
    out = np.zeros((len(ptr) - 1, WIDTH), np.float32)
    lo, n = 0, len(ptr) - 1
    while lo < n:  # as many texts as have about BLOCK tokens; a longer text a block at a time
        hi = max(lo + 1, int(np.searchsorted(ptr, ptr[lo] + BLOCK, "right")) - 1)
        own = b[ptr[lo] : ptr[hi]]
        if len(own) > BLOCK:
            for i in range(0, len(own), BLOCK):
                out[lo] += vectors[own[i : i + BLOCK]].astype(np.float32).sum(0)
        elif len(own):
            full = lo + np.flatnonzero(np.diff(ptr[lo : hi + 1]) > 0)
            out[full] = np.add.reduceat(vectors[own].astype(np.float32), ptr[full] - ptr[lo], axis=0)
        lo = hi
    return (out + PRIOR * prior) / (np.diff(ptr)[:, None] + PRIOR)


@dataclass
class Model:
    vectors: np.ndarray
    prior: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit(texts: list[str], good: np.ndarray, vectors: np.ndarray, seed: int = 7) -> Model:
    """The network from labelled texts; a fifth is held out for the temperature."""
    buckets = len(vectors)
    parts = [tokens(buf, offs, buckets) for _, _, buf, offs in text_chunks(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}), "text", lower=False)]
    b = np.concatenate([x for x, _ in parts])
    ptr = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p) for _, p in parts]))])
    y = good.astype(float)
    fine = np.repeat(y > 0, np.diff(ptr))
    seen = np.bincount(b[fine], minlength=buckets)
    prior = seen @ vectors.astype(np.float32) / seen.sum() if seen.any() else np.zeros(WIDTH)
    x = pooled(vectors, prior, b, ptr).astype(float)
    rng = np.random.RandomState(seed)
    held = rng.rand(len(y)) < 0.2
    mean, scale = x[~held].mean(0), x[~held].std(0) + 1e-3
    m = Model(vectors, prior, mean, scale, rng.randn(WIDTH, HIDDEN) / WIDTH**0.5, np.zeros(HIDDEN), rng.randn(HIDDEN) / HIDDEN**0.5, 0.0, 1.0)
    z, t = (x[~held] - mean) / scale, y[~held]
    weight = np.where(t > 0, 0.5 / max(t.mean(), 1e-9), 0.5 / max(1 - t.mean(), 1e-9))
    p = [m.w1, m.b1, m.w2, np.zeros(1)]
    s1, s2 = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, 401):
        h = np.tanh(z @ p[0] + p[1])
        e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t) * weight / len(t)
        back = np.outer(e, p[2]) * (1 - h * h)
        grads = [z.T @ back + 1e-4 * p[0], back.sum(0), h.T @ e + 1e-4 * p[2], np.array([e.sum()])]
        for i, g in enumerate(grads):
            s1[i] = 0.9 * s1[i] + 0.1 * g
            s2[i] = 0.999 * s2[i] + 0.001 * g * g
            p[i] -= 0.02 * (s1[i] / (1 - 0.9**step)) / (np.sqrt(s2[i] / (1 - 0.999**step)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = p[0], p[1], p[2], float(p[3][0])
    if held.sum() > 20:
        logit, truth = m.logit(x[held]), y[held]
        loss = lambda k: np.logaddexp(0, np.where(truth > 0, -logit, logit) / k).mean()
        m.temperature = float(min(np.geomspace(0.05, 8, 81), key=loss))
    return m


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Word vectors of all documents, and the network fitted on at most `fit_rows` labelled ones of each class, those of
    least hash of their id (of an id with several labels the greatest counts, of one with several texts the least).
    None if a class has none: then every document passes."""
    lab = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    pick = [r for q in (0, 1) for r in lab.where(F.col("y") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect()]
    want = dict((r[0], r[1]) for r in pick)
    if len(set(want.values())) < 2:
        return None
    spark, flat = docs.sparkSession, keyed_text(docs, id_col, text_col)
    ids = spark.createDataFrame([(i,) for i in want], "doc_id bigint")
    got = {r[0]: r[1] for r in flat.join(F.broadcast(ids), "doc_id").where("text is not null").groupBy("doc_id").agg(F.min("text")).collect()}  # 2 * fit_rows at most
    order = sorted(got)
    y = np.array([want[i] for i in order], float)
    if not 0 < y.sum() < len(y):
        return None
    return fit([got[i] for i in order], y, word_vectors(flat, buckets_for(docs.count())))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p = np.ones(batch.num_rows)
            if m is not None:
                for lo, hi, buf, offs in text_chunks(batch, "text", BYTES, False):
                    b, ptr = tokens(buf, offs, len(m.vectors))
                    p[lo:hi] = np.where(np.diff(ptr) > 0, m.probability(pooled(m.vectors, m.prior, b, ptr)), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(p, 6)), *batch.columns[2:]], ["doc_id", "p_good", *batch.schema.names[2:]])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_good, keep) for each row: keep is p_good >= threshold.

    Null, empty or tokenless texts have p_good 0 and are rejected.  Rows that repeat, and null ids, are scored like any
    other.  Without labels of both classes nothing is rejected (p_good 1).  An empty table gives an empty result; other
    columns are ignored.  The model has at most MOST vectors of 64 bytes, so it is broadcast.  Runs jobs while the result is built.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fit_rows, id_col, text_col))
    out = keyed_text(docs, id_col, text_col).mapInArrow(_score(shared), "doc_id bigint, p_good double")
    return out.withColumn("keep", F.col("p_good") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that pass, with all their columns; one narrow pass, no join.  Nulls as in `quality_scores`."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fit_rows, "doc_id", text_col))
    tmp = [f"_c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*tmp)
    at = tmp[docs.columns.index(text_col)]
    packed = flat.select(F.lit(0).cast("bigint").alias("doc_id"), F.col(at).alias("text"), *tmp)
    kinds = ", ".join(f"{n} {t}" for n, t in flat.dtypes)
    scored = packed.mapInArrow(_score(shared), f"doc_id bigint, p_good double, {kinds}")
    return scored.where(F.col("p_good") >= threshold).select(*tmp).toDF(*docs.columns)
