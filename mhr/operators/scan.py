"""The best rows for each of many queries, of tables of any size: blocks on disk are streamed past the queries of a task.

The searched side is written once, as blocks, into the shared folder; a task holds a bounded number of queries and what is best
for each so far, and reads all blocks.  Single-precision products with a bound of their error leave out what can't be among the
best; the rest is scored in double precision and rounded, so results are exact.  Work is the product of both sides, but what is
written and shuffled grows as their sum, and a task's memory is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mhr.sources.shared import stored

#: Rows of a tile of queries, and of the blocks that are multiplied with it; queries of a task at once, and places they may keep.
TILE, STEP, ASKED, PLACES = 2048, 4096, 16_384, 8_000_000
#: Rows that are scored in double precision at once, pairs that are.
DENSE, PAIRS = 512, 4096
#: Products made at once, which should stay in a core's cache, and rows of a block that are compared by their greatest product.
CACHED, GROUP = 1 << 18, 16


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column as a float64 matrix; ValueError if lengths differ."""
    sizes = np.diff(col.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of one head differ in dimension")
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), int(sizes[0]) if len(sizes) else 0)


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(n > 1e-12, m / np.maximum(n, 1e-300), 0.0)


def kept(s: np.ndarray, m: int, loose: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places of the m best of each row, columns being in order of ids: every score above the m-th, and of its ties the first.
    loose: all that may be, as products cancel for near vectors."""
    if s.shape[1] <= m:
        return np.nonzero(np.ones(s.shape, bool))
    floor = -np.partition(-s, m - 1, axis=1)[:, m - 1 : m]
    if loose:
        return np.nonzero(s >= floor - 1e-6)
    above, tie = s > floor, s == floor
    return np.nonzero(above | (tie & (np.cumsum(tie, 1) <= m - above.sum(1, keepdims=True))))


class Block:
    """Rows of the searched side in order of ids, as they are and in single precision with norms of at most 1."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, metric: str):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        near = np.column_stack([self.rows, (self.rows**2).sum(1) / 2]) if metric == "l2" else self.rows
        self.most = 1.0 if metric == "cosine" else max(1e-300, float(np.linalg.norm(near, axis=1).max(initial=0)))
        self.near = np.zeros((-(-len(near) // GROUP) * GROUP, near.shape[1]), np.float32)
        self.near[: len(near)] = near / self.most


class Best:
    """The m best of each query, of the blocks added so far: by score, then the smaller id.

    metric: cosine (of unit rows), dot_product, l2 (the score is the negative distance), or a number n: the mean of n cosines, the
    rows being unit vectors set side by side.
    """

    def __init__(self, rows: np.ndarray, metric: str | int, m: int):
        self.rows, self.metric, self.m, self.n = rows, metric, m, len(rows)
        near = np.column_stack([rows, np.full(self.n, -1.0)]) if metric == "l2" else rows
        self.norm = np.maximum(np.linalg.norm(near, axis=1), 1e-300)
        self.near = (near / self.norm[:, None]).astype(np.float32)
        self.error = (near.shape[1] + 8) * 2.0**-23  # twice what rounding can do to a product of rows of norm 1
        self.square = (rows**2).sum(1) if metric == "l2" else None
        self.floor = np.full(self.n, -np.inf)  # the m-th best score
        self.have = np.zeros(self.n, np.int64)
        self.down, self.docs = np.empty((self.n, 0)), np.empty((self.n, 0), np.int64)  # the best, negative, and their ids; the first `have` of a row are filled
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    @property
    def r(self) -> np.ndarray:
        """The query of each of the best that were merged; queries in order, their best first."""
        return np.repeat(np.arange(self.n), self.have)

    @property
    def ids(self) -> np.ndarray:
        return self.docs[np.arange(self.docs.shape[1]) < self.have[:, None]]

    @property
    def s(self) -> np.ndarray:
        return -self.down[np.arange(self.down.shape[1]) < self.have[:, None]] + 0.0

    def scored(self, s: np.ndarray) -> np.ndarray:
        if self.metric == "cosine":
            s = np.clip(s, -1, 1)
        s = np.round(s, 9)
        return (s if isinstance(self.metric, str) else np.round(s / self.metric, 9)) + 0.0

    def least(self, block: Block, at: np.ndarray) -> np.ndarray:
        """Single-precision products below these can't be of rows as good as the m-th best."""
        t = self.floor[at]
        if self.metric == "l2":
            far = (1e-9 - t) * (1 + 1e-12)
            low = (self.square[at] - far * far) / 2 - 1e-12 * (self.square[at] + far * far)
        else:
            n = 1 if isinstance(self.metric, str) else self.metric
            low = n * t - (n + 1) * 1e-9 - 1e-12 * np.abs(n * t)
        return low / (self.norm[at] * block.most) - self.error

    def add(self, block: Block, of: np.ndarray | None = None) -> None:
        """of: the queries that the block is for, all by default."""
        if not len(block.ids):
            return
        at = np.arange(self.n) if of is None else of
        open_ = ~np.isfinite(self.floor[at])
        dense, at = [at[open_]], at[~open_]
        if len(at):
            low = np.maximum(self.least(block, at), np.finfo(np.float32).min).astype(np.float32)
            r, c = self.hits(block, self.near if len(at) == self.n else self.near[at], low)
            many = np.bincount(r, minlength=len(at)) > max(4 * self.m, len(block.ids) // 8)
            if many.any():
                dense.append(at[many])
                few = ~many[r]
                r, c = r[few], c[few]
            for lo in range(0, len(r), PAIRS):
                self.pairs(block, at[r[lo : lo + PAIRS]], c[lo : lo + PAIRS])
        whole = np.concatenate(dense)
        for lo in range(0, len(whole), DENSE):
            self.dense(block, whole[lo : lo + DENSE])
        if self.waiting >= max(4096, self.n * self.m // 4):
            self.merge()

    @staticmethod
    def hits(block: Block, near: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row of the block) wherever the product isn't below the query's bound.

        Products are made a piece at a time; of each GROUP rows only the greatest is compared, as few groups have any to keep.
        """
        n, found = len(near), []
        step = max(1, min(512, CACHED // n) // GROUP) * GROUP
        room = np.empty((min(step, len(block.near)), n), np.float32)
        for lo in range(0, len(block.near), step):
            rows = block.near[lo : lo + step]
            s = np.matmul(rows, near.T, out=room[: len(rows)]).reshape(-1, GROUP, n)
            some = ~(s.max(axis=1) < low).ravel()  # a product that is no number hides no other
            if some.size % 8 == 0:
                words = np.flatnonzero(some.view(np.uint64))
                i = (words[:, None] * 8 + np.arange(8)).ravel()
                i = i[some[i]]
            else:
                i = np.flatnonzero(some)
            if len(i):
                g, r = np.divmod(i, n)
                at, c = np.nonzero(s[g, :, r] >= low[r][:, None])
                found.append((r[at], lo + g[at] * GROUP + c))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        r, c = (np.concatenate(x) for x in zip(*found))
        own = c < len(block.ids)  # rows that fill the last group
        return r[own], c[own]

    def pairs(self, block: Block, r: np.ndarray, c: np.ndarray) -> None:
        a, b = self.rows[r], block.rows[c]
        s = self.scored(-np.linalg.norm(a - b, axis=1) if self.metric == "l2" else np.einsum("ij,ij->i", a, b))
        good = s >= self.floor[r]
        self.put(r[good], block.ids[c[good]], s[good])

    def dense(self, block: Block, at: np.ndarray) -> None:
        s = self.rows[at] @ block.rows.T
        if self.metric == "l2":
            s = -np.sqrt(np.maximum(self.square[at][:, None] + (block.rows**2).sum(1) - 2 * s, 0))
            r, c = kept(s, self.m, True)
            for lo in range(0, len(r), PAIRS):
                self.pairs(block, at[r[lo : lo + PAIRS]], c[lo : lo + PAIRS])
        else:
            s = self.scored(s)
            r, c = kept(s, self.m)
            self.put(at[r], block.ids[c], s[r, c])

    def put(self, r: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        self.new.append((r, ids, s))
        self.waiting += len(r)

    def merge(self) -> None:
        if not self.new:
            return
        r, ids, s = (np.concatenate(x) for x in zip(*self.new))
        order = np.argsort(r, kind="stable")
        r, ids, s = r[order], ids[order], s[order]
        count = np.bincount(r, minlength=self.n)
        place = np.arange(len(r)) - (np.cumsum(count) - count)[r]
        more = min(self.m, int((self.have + count).max())) - self.down.shape[1]
        if more > 0:
            self.down = np.column_stack([self.down, np.full((self.n, more), np.nan)])
            self.docs = np.column_stack([self.docs, np.full((self.n, more), np.iinfo(np.int64).max)])
        old, size = self.down.shape[1], np.frexp(count)[1]
        for w in np.unique(size[size > 0]):  # queries with about as many new ones
            rows, own = np.flatnonzero(size == w), size[r] == w
            width = old + int(count[rows].max())
            down, docs = np.full((len(rows), width), np.nan), np.full((len(rows), width), np.iinfo(np.int64).max)  # sorted last
            down[:, :old], docs[:, :old] = self.down[rows], self.docs[rows]
            at = np.searchsorted(rows, r[own]), old + place[own]
            down[at], docs[at] = -s[own], ids[own]
            order = np.lexsort((docs, down))[:, :old]
            self.down[rows], self.docs[rows] = np.take_along_axis(down, order, 1), np.take_along_axis(docs, order, 1)
        self.have = np.minimum(self.have + count, self.m)
        full = (count > 0) & (self.have == self.m)
        if full.any():
            self.floor[full] = -self.down[full, self.m - 1] + 0.0
        self.new, self.waiting = [], 0


def files_of(blocks: DataFrame) -> list[str]:
    """The files of a table of blocks; one that isn't a table as it was read is written first."""
    if not getattr(blocks, "_as_read", False):
        blocks = stored(blocks, "blocks")
    return sorted(blocks.inputFiles())


def rows_of(files: Sequence[str], columns: Sequence[str]) -> Iterator[tuple[str, list[bytes]]]:
    """(file, cells) of each row of the files; on an executor."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    for file in files:
        fs, name = FileSystem.from_uri(file)
        with fs.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(4, columns=list(columns), use_threads=False):
                for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                    yield file, row


def steps(parts: Iterator[tuple[object, int, np.ndarray, np.ndarray]], metric: str | int) -> Iterator[tuple[object, int, Block]]:
    """Blocks of about STEP rows of (group, head, ids, rows): small ones of one group and head that follow each other are joined."""
    held: dict[int, tuple[object, list]] = {}

    def joined(head: int) -> tuple[object, int, Block]:
        group, own = held.pop(head)
        return group, head, Block(np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own]), metric)

    for group, head, ids, rows in parts:
        if not len(ids):
            continue
        if head in held and (held[head][0] != group or held[head][1][0][1].shape[1] != rows.shape[1]):
            yield joined(head)
        for lo in range(0, len(ids), STEP):
            held.setdefault(head, (group, []))[1].append((ids[lo : lo + STEP], rows[lo : lo + STEP]))
            if sum(len(x) for x, _ in held[head][1]) >= STEP:
                yield joined(head)
    for head in list(held):
        yield joined(head)


def over(queries: DataFrame, by: str, asked: int, search: Callable, schema: str) -> DataFrame:
    """search(table of at most `asked` rows) yields record batches; queries, the first column being their id, are spread by it."""
    rows, cores = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(-(-rows // 512), 4 * cores), -(-rows // asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE):
                held.append(batch.slice(lo, TILE))
                if sum(b.num_rows for b in held) + TILE > asked:
                    yield from search(pa.Table.from_batches(held))
                    held = []
        if held:
            yield from search(pa.Table.from_batches(held))

    return queries.repartition(parts, F.col(by)).mapInArrow(run, schema)
