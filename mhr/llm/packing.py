"""Operator 8: best-fit packing of documents into sequences of a token capacity, improved by swap-based local search.

Documents longer than the capacity are cut into full sequences and a rest.  Pieces are spread over groups of bounded size by
a seeded hash; each group is packed best-fit decreasing, then underfull bins exchange pieces (move of one or two, one for one,
two for one) whenever that raises the sum of squared fills, until no such exchange between any two bins of the group is left.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words

CAPACITY, GROUP, SEED = 2048, 20_000, 29
#: Copies of one repeated row that a task makes pieces of.
COPIES = 65_536
#: Partners are tried in blocks, the fullest first, this many at first and then four times as many each; all of them before a bin is settled.
BLOCK = 128


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of piece numbers) by best-fit decreasing; equal sizes in order of their number."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        k = bisect_left(room, (sizes[i], -1))
        if k < len(room):
            left, b = room.pop(k)
            bins[b].append(i)
            insort(room, (left - sizes[i], b))
        else:
            bins.append([i])
            insort(room, (capacity - sizes[i], len(bins) - 1))
    return bins


class _Bins:
    """Underfull bins, with the distinct sums of their pieces as sorted keys bin * width + sum: of none and one, and of two."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.sizes, self.capacity, self.width = bins, sizes, capacity, capacity + 1
        self.fill = np.array([sum(sizes[i] for i in b) for b in bins], np.int64)
        self.one, self.two = (np.concatenate([self._keys(b, of) for b in range(len(bins))]) for of in (self.ones, self.twos))

    def ones(self, b: int) -> dict[int, tuple[int, ...]]:
        return {0: ()} | {self.sizes[i]: (i,) for i in reversed(self.bins[b])}

    def twos(self, b: int) -> dict[int, tuple[int, ...]]:
        by: dict[int, list[int]] = {}
        for i in self.bins[b]:
            by.setdefault(self.sizes[i], []).append(i)
        kinds, out = sorted(by), {}
        for x, v in enumerate(kinds):
            if len(by[v]) > 1:
                out[2 * v] = (by[v][0], by[v][1])
            for w in kinds[:x]:
                out[v + w] = (by[v][0], by[w][0])
        return out

    def _keys(self, b: int, of) -> np.ndarray:
        return np.array(sorted(of(b)), np.int64) + b * self.width

    def set(self, b: int, pieces: list[int]) -> None:
        self.bins[b], self.fill[b] = pieces, sum(self.sizes[i] for i in pieces)
        for name, of in (("one", self.ones), ("two", self.twos)):
            keys = getattr(self, name)
            lo, hi = np.searchsorted(keys, (b * self.width, (b + 1) * self.width))
            setattr(self, name, np.concatenate([keys[:lo], self._keys(b, of), keys[hi:]]))

    def best(self, x: int, others: np.ndarray) -> tuple[int, int, int, int, int] | None:
        """(gain, giver, receiver, sum given, sum given back) of the best exchange of x with one of `others`.

        A shift of d tokens from a bin of fill f to one of fill g changes the sum of squares by 2d(g - f + d), which grows
        with d where it is positive: of each pair only the largest d that fits need be tried.
        """
        one, two = (np.array(sorted(of(x)), np.int64) for of in (self.ones, self.twos))
        fx, fo, found = int(self.fill[x]), self.fill[others], None
        base = others * self.width
        for mine, keys in ((one, self.one), (two, self.one), (one, self.two)):
            if not len(mine) or not len(keys):
                continue
            # x gives: of the other's sums the least that makes the shift fit; x receives: the largest that fits.
            for gives in (True, False):
                if gives:
                    need = np.maximum(mine[None, :] - (self.capacity - fo)[:, None], 0) + base[:, None]
                    at = np.searchsorted(keys, need.ravel()).reshape(need.shape)
                else:
                    need = np.minimum(mine[None, :] + (self.capacity - fx), self.capacity) + base[:, None]
                    at = np.searchsorted(keys, need.ravel(), "right").reshape(need.shape) - 1
                theirs = keys[np.clip(at, 0, len(keys) - 1)] - base[:, None]
                ok = (at >= 0) & (at < len(keys)) & (theirs >= 0) & (theirs <= self.capacity)
                d = mine[None, :] - theirs if gives else theirs - mine[None, :]
                toward = (fo - fx if gives else fx - fo)[:, None]
                gain = np.where(ok & (d > 0), 2 * d * (toward + d), 0)
                k = int(gain.argmax())
                r, c = divmod(k, len(mine))
                if gain[r, c] > 0 and (found is None or gain[r, c] > found[0]):
                    o, m, t = int(others[r]), int(mine[c]), int(theirs[r, c])
                    found = (int(gain[r, c]), x, o, m, t) if gives else (int(gain[r, c]), o, x, t, m)
        return found


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Exchanges between underfull bins that raise the sum of squared fills, until none is left; emptied bins go.

    A bin is settled once no exchange with any other is left, and unsettled when its pieces change; every exchange raises a
    bounded whole number, so all bins settle.  Full and empty bins can't take part in one that raises it.
    """
    size = lambda b: sum(sizes[i] for i in b)
    full, under = [b for b in bins if size(b) == capacity], [b[:] for b in bins if size(b) < capacity]
    if len(under) < 2:
        return full + under
    under.sort(key=lambda b: (size(b), min(b)))
    state = _Bins(under, sizes, capacity)
    todo, waiting, changes, order = deque(range(len(under))), np.ones(len(under), bool), 0, None
    while todo:
        x = todo.popleft()
        waiting[x] = False
        while 0 < state.fill[x] < capacity:
            if order is None or changes % 16 == 0:
                order = np.argsort(-state.fill, kind="stable")
            others = order[(state.fill[order] < capacity) & (state.fill[order] > 0) & (order != x)]
            found, lo, step = None, 0, BLOCK
            while found is None and lo < len(others):
                found, lo, step = state.best(x, others[lo : lo + step]), lo + step, 4 * step
            if found is None:
                break
            _, giver, receiver, given, back = found
            changes += 1
            give, take = (({**state.twos(b), **state.ones(b)})[s] for b, s in ((giver, given), (receiver, back)))
            a, b = state.bins[giver], state.bins[receiver]
            state.set(giver, [i for i in a if i not in give] + list(take))
            state.set(receiver, [i for i in b if i not in take] + list(give))
            other = receiver if giver == x else giver
            if not waiting[other]:
                waiting[other] = True
                todo.append(other)
    return full + [b for b in state.bins if b]


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "key", "copy", "piece"], ignore_index=True)
        sizes = pdf["n_tokens"].tolist()
        whole = [[i] for i, s in enumerate(sizes) if s == capacity]
        open_ = [i for i, s in enumerate(sizes) if s < capacity]
        own = [sizes[i] for i in open_]
        bins = whole + [[open_[i] for i in b] for b in local_search(best_fit(own, capacity), own, capacity)]
        bins.sort(key=min)
        bin_of, slot, fill = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, b in enumerate(bins):
            b.sort()
            bin_of[b], slot[b], fill[b] = k, np.arange(len(b)), sum(sizes[i] for i in b)
        return pdf.assign(bin=bin_of, slot=slot, fill=fill)[["doc_id", "piece", "n_tokens", "group", "bin", "slot", "fill"]]

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_id, slot, fill): tokens start .. start + n_tokens - 1 of the document stand at
    place `slot` of sequence bin_id, which holds `fill` tokens.

    Tokens are words parted by white space.  A document of more than `capacity` tokens has several pieces, all but the last
    full.  Null, empty and blank texts have no tokens and are in no bin.  Null ids are packed like others; rows that repeat
    are numbered, and so spread over the groups like others, not heaped in one (ties in order of id, hash of the text, then
    that number).  The search goes on until no exchange inside a group is left; a group has about `group` pieces.  An empty
    table gives an empty result; other columns are ignored.  Runs a job while the result is built.
    """
    flat = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), n_words(F.col(text_col).cast("string")).alias("n"))
    return _packed(flat, capacity, group, seed)


def _packed(flat: DataFrame, capacity: int, group: int, seed: int) -> DataFrame:
    from .common import stored

    flat = stored(flat.where("n > 0").groupBy("doc_id", "key", "n").agg(F.count("*").alias("copies")), "lengths")
    count, most = flat.agg(F.sum(F.ceil(F.col("n") / capacity) * F.col("copies")), F.max("copies")).first()
    blocks = flat.withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPIES).cast("bigint"))))
    if (most or 0) > COPIES:
        blocks = blocks.repartition("doc_id", "key", "first")
    each = blocks.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + COPIES, "copies") - 1)))
    cut = each.select("doc_id", "key", "copy", F.posexplode(F.transform(F.sequence(F.lit(0), (F.ceil(F.col("n") / capacity) - 1).cast("int")), lambda i: F.least(F.lit(capacity), F.col("n") - i * capacity).cast("bigint"))).alias("piece", "n_tokens"))
    spread = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "key", "copy", "piece"), F.lit(max(1, ceil((count or 0) / group))))
    out = cut.withColumn("group", spread).groupBy("group").applyInPandas(_pack(capacity), "doc_id bigint, piece int, n_tokens bigint, group bigint, bin bigint, slot bigint, fill bigint")
    return out.select("doc_id", "piece", (F.col("piece") * F.lit(capacity)).cast("bigint").alias("start"), "n_tokens", (F.col("group") * F.lit(1 << 32) + F.col("bin")).alias("bin_id"), "slot", "fill")
