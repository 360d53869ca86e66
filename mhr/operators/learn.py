"""Learned projections (InfoNCE) and the gating network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .search import matrix

TAU = 0.07


@dataclass
class Projection:
    """Square matrices of queries, keys and values."""

    q: np.ndarray
    k: np.ndarray
    v: np.ndarray

    @classmethod
    def init(cls, dim: int, seed: int = 0) -> Projection:
        r, s = np.random.RandomState(seed), 1 / dim**0.5
        return cls(*(r.uniform(-s / 2, s / 2, (dim, dim)) for _ in range(3)))

    def update(self, w: np.ndarray) -> None:
        """New keys and values; queries stay."""
        self.k, self.v = w.copy(), w.copy()


def info_nce_gradients(p: Projection, q: np.ndarray, pos: np.ndarray, negs: np.ndarray, tau: float = TAU) -> tuple[float, np.ndarray, np.ndarray]:
    """(sum of losses, gradient of q, gradient of k) of pairs q, pos (n, d) with negs (m, d) for all."""
    a = q @ p.q.T
    keys = np.concatenate([(pos @ p.k.T)[:, None], np.broadcast_to(negs @ p.k.T, (len(q), *negs.shape))], 1)
    raw = np.concatenate([pos[:, None], np.broadcast_to(negs, (len(q), *negs.shape))], 1)
    z = np.einsum("nd,nkd->nk", a, keys) / tau
    z -= z.max(1, keepdims=True)
    share = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    loss = -np.log(np.maximum(share[:, 0], 1e-300)).sum()
    share[:, 0] -= 1
    share /= tau
    return float(loss), np.einsum("nk,nkd,ne->de", share, keys, q), np.einsum("nk,nd,nke->de", share, a, raw)


def train_step(pairs: DataFrame, negatives: np.ndarray, p: Projection, rate: float = 0.01) -> float:
    """One full-batch step over (q, pos); each partition sends its summed gradients, one row.  Mean loss before the step.

    The values' matrix follows the keys'.  ValueError without pairs or negatives.
    """
    if not len(negatives):
        raise ValueError("no negatives")
    shared = pairs.sparkSession.sparkContext.broadcast((p, np.asarray(negatives, float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, negs = shared.value
        n, loss, gq, gk = 0, 0.0, np.zeros_like(now.q), np.zeros_like(now.k)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                x, g1, g2 = info_nce_gradients(now, matrix(part.column(0)), matrix(part.column(1)), negs)
                n, loss, gq, gk = n + part.num_rows, loss + x, gq + g1, gk + g2
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([gq.tobytes()]), pa.array([gk.tobytes()])], ["n", "loss", "gq", "gk"])

    rows = pairs.selectExpr("cast(q as array<double>) q", "cast(pos as array<double>) pos").dropna().mapInArrow(run, "n bigint, loss double, gq binary, gk binary").where("n > 0").collect()
    n = sum(r.n for r in rows)
    if not n:
        raise ValueError("no pairs")
    total = lambda name: sum(np.frombuffer(bytes(r[name])).reshape(p.q.shape) for r in rows) / n
    gk = total("gk")
    p.q, p.k, p.v = p.q - rate * total("gq"), p.k - rate * gk, p.v - rate * gk
    return sum(r.loss for r in rows) / n


def reproject(vectors: DataFrame, w: np.ndarray, vec: str = "vec") -> DataFrame:
    """All rows with the vector mapped by w: batches as matrix products."""
    others = [c for c in vectors.columns if c != vec]
    shared = vectors.sparkSession.sparkContext.broadcast(np.asarray(w, float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column(0)) @ shared.value.T if b.num_rows else np.zeros((0, len(shared.value)))
            lists = pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], m.reshape(-1))
            yield pa.RecordBatch.from_arrays([lists, *b.columns[1:]], [vec, *others])

    kinds = "".join(f", `{c}` {t}" for c, t in vectors.dtypes if c != vec)
    flat = vectors.where(f"`{vec}` is not null").selectExpr(f"cast(`{vec}` as array<double>) as `{vec}`", *[f"`{c}`" for c in others])
    return flat.mapInArrow(run, f"`{vec}` array<double>{kinds}").select(*vectors.columns)


@dataclass
class Gating:
    """softmax(W q + b), trained one example at a time with momentum."""

    heads: int
    dim: int
    seed: int = 0
    rate: float = 0.01
    momentum: float = 0.9
    w: np.ndarray = field(init=False)
    b: np.ndarray = field(init=False)

    def __post_init__(self):
        s = 1 / self.dim**0.5
        self.w = np.random.RandomState(self.seed).uniform(-s, s, (self.heads, self.dim))
        self.b = np.zeros(self.heads)
        self._w, self._b = np.zeros_like(self.w), np.zeros_like(self.b)

    def forward(self, q: np.ndarray) -> np.ndarray:
        z = self.w @ q + self.b
        e = np.exp(z - z.max())
        return e / e.sum()

    def train_step(self, q: np.ndarray, target: np.ndarray) -> float:
        """Cross-entropy before the step."""
        p = self.forward(q)
        g = p - target
        self._w = self.momentum * self._w - self.rate * np.outer(g, q)
        self._b = self.momentum * self._b - self.rate * g
        self.w, self.b = np.clip(self.w + self._w, -10, 10), np.clip(self.b + self._b, -10, 10)
        return float(-(target * np.log(np.maximum(p, 1e-12))).sum())

    def train(self, examples: list[tuple[np.ndarray, np.ndarray]], epochs: int = 100, patience: int = 5, least: float = 1e-3) -> float:
        """Best mean loss; ends early after `patience` epochs without a gain of `least`."""
        best, stale = float("inf"), 0
        for _ in range(epochs):
            loss = sum(self.train_step(np.asarray(q, float), np.asarray(t, float)) for q, t in examples) / max(1, len(examples))
            best, stale = (loss, 0) if loss < best - least else (best, stale + 1)
            if stale >= patience:
                break
        return best

    def flat(self) -> list[float]:
        return [*self.w.reshape(-1), *self.b]

    def load(self, values: list[float]) -> bool:
        """False, and no change, if the length is wrong."""
        if len(values) != self.w.size + self.b.size:
            return False
        self.w, self.b = np.array(values[: self.w.size]).reshape(self.w.shape), np.array(values[self.w.size :])
        return True
