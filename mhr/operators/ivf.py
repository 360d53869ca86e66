"""Approximate search: k-means cells, of which each query probes the nearest; the rest is exact.

There are about as many cells as the square root of the rows.  Centroids, and how many cells must be probed for a recall,
are fitted on a bounded sample; centroids alone are broadcast.  The index is a table of blocks of unit vectors, each of one
cell, written in folders by cell.  A task streams it past its queries, and a cell's blocks are multiplied with those queries that
probe it: no query is copied, and only each query's best are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mhr.sources.shared import new_path

from .scan import ASKED, PLACES, TILE, Best, files_of, matrix, over, rows_of, steps, unit_rows
from .search import _rows, ranked

#: Vectors to fit on, at most; k-means steps; sampled queries that set the probes; bounds of the number of cells.
SAMPLE, STEPS, TRIALS, LEAST, MOST = 20_000, 12, 200, 4, 4096
BLOCK = 4096
EF = 64


def cells_for(rows: int) -> int:
    return int(min(MOST, max(LEAST, round(rows**0.5 / 2))))


def recall_for(ef: int) -> float:
    """The recall that a search width asks for: .8, .9, .95 and .975 for ef 32, 64, 128 and 256."""
    return 1 - 6.4 / max(8, ef)


class Cells:
    """Centroids of a sample, and for each recall how many cells have it there."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 3, k: int = 10):
        x, r = unit_rows(sample), np.random.RandomState(seed)
        self.centroids = x[r.permutation(len(x))[:cells]]
        for _ in range(STEPS):
            at = self.near(x, 1)[:, 0] if len(x) else np.empty(0, np.int64)
            s = np.zeros_like(self.centroids)
            np.add.at(s, at, x)
            n = np.linalg.norm(s, axis=1, keepdims=True)
            self.centroids = np.where(n > 0, s / np.maximum(n, 1e-12), self.centroids)
        n = max(1, len(self.centroids))
        self.found = np.zeros(n)  # share of the k nearest in the i + 1 nearest cells
        ask = x[r.permutation(len(x))[:TRIALS]]
        if len(ask):
            at, order = self.near(x, 1)[:, 0], self.near(ask, n)
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(n)[None, :], 1)
            best = np.argsort(-(ask @ x.T), axis=1, kind="stable")[:, :k]
            self.found = np.cumsum(np.bincount(np.take_along_axis(place, at[best], 1).ravel(), minlength=n)) / best.size

    def near(self, x: np.ndarray, n: int) -> np.ndarray:
        s = x @ self.centroids.T
        return s.argmax(1)[:, None] if n == 1 and s.shape[1] else np.argsort(-s, axis=1, kind="stable")[:, :n]

    def probes(self, recall: float) -> int:
        """Cells to probe, with a margin of a fiftieth for what the sample doesn't show."""
        return int(min(len(self.found), 1 + np.searchsorted(self.found, min(1.0, recall + 0.02) - 1e-12)))


def fit(vectors: DataFrame, cells: int | None = None, vec: str = "vec", sample: int = SAMPLE, seed: int = 3) -> Cells:
    """Spherical k-means on at most `sample` vectors, those of least hash of their id."""
    some = vectors.where(f"{vec} is not null and doc_num is not null")
    rows = some.orderBy(F.xxhash64(F.lit(seed), "doc_num"), "doc_num").limit(sample).select(F.col(vec).cast("array<double>").alias("v"))
    batches = rows.toArrow().column(0).combine_chunks()
    return Cells(matrix(batches) if len(batches) else np.empty((0, 1)), cells or cells_for(some.count()), seed)


def _packed(cells: Cells):
    """Blocks (cell, ids, matrix): rows of a batch, each in its nearest cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                ids, m = np.asarray(part.column(0), np.int64), unit_rows(matrix(part.column(1)))
                _same_width(m, cells)
                of = cells.near(m, 1)[:, 0]
                order = np.argsort(of, kind="stable")
                cut = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1]))
                groups = np.split(order, cut[1:])
                yield pa.RecordBatch.from_arrays([pa.array([int(of[g[0]]) for g in groups], pa.int32()), *(pa.array([x[g].tobytes() for g in groups], pa.binary()) for x in (ids, m))], ["cell", "d_ids", "d_m"])

    return run


def _same_width(m: np.ndarray, cells: Cells) -> None:
    if m.shape[1] != cells.centroids.shape[1]:
        raise ValueError(f"vectors have {m.shape[1]} dimensions, the index {cells.centroids.shape[1]}")


def _flat(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v")).dropna()


def index(vectors: DataFrame, cells: Cells, vec: str = "vec") -> DataFrame:
    """(cell, d_ids, d_m) blocks of all vectors.  Null ids and vectors are left out."""
    if not len(cells.centroids):
        return vectors.sparkSession.createDataFrame([], "cell int, d_ids binary, d_m binary")
    return _flat(vectors, "doc_num", vec).mapInArrow(_packed(cells), "cell int, d_ids binary, d_m binary")


def write(vectors: DataFrame, cells: Cells, path: str, vec: str = "vec") -> None:
    """The index as a table with a folder a cell: a search of few cells reads those alone."""
    _write(index(vectors, cells, vec), path)


def _write(blocks: DataFrame, path: str) -> None:
    blocks.repartition("cell").write.mode("append").partitionBy("cell").parquet(path)


def append(vectors: DataFrame, cells: Cells, path: str, vec: str = "vec") -> None:
    """More vectors in a written index, their cells by the centroids as they are."""
    _write(index(vectors, cells, vec), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    blocks = spark.read.schema("d_ids binary, d_m binary, cell int").parquet(path)
    blocks._as_read = True
    return blocks


def search(blocks: DataFrame, cells: Cells, queries: DataFrame, k: int, ef: int = EF, probes: int | None = None, vec: str = "vec") -> DataFrame:
    """(qid, rank, doc_num, score) by cosine among the probed cells: `probes` of them, or as many as the recall of `ef` takes."""
    spark = queries.sparkSession
    if not len(cells.centroids):
        return spark.createDataFrame([], "qid bigint, rank bigint, doc_num bigint, score double")
    n = min(len(cells.centroids), probes or cells.probes(recall_for(ef)))
    if not getattr(blocks, "_as_read", False):
        path = new_path(spark, "ivf")
        _write(blocks, path)
        blocks = read(spark, path)
    files = files_of(blocks)

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        qids, rows = np.asarray(table.column(0), np.int64), unit_rows(matrix(table.column(1).combine_chunks()))
        _same_width(rows, cells)
        tiles = []
        for lo in range(0, len(qids), TILE):
            part = rows[lo : lo + TILE]
            probed = np.zeros((len(part), len(cells.centroids)), bool)
            np.put_along_axis(probed, cells.near(part, n), True, 1)
            tiles.append((qids[lo : lo + TILE], probed, Best(part, "cosine", k)))

        def parts():
            for file, (ids, m) in rows_of(files, ["d_ids", "d_m"]):
                ids = np.frombuffer(ids, np.int64)
                yield int(re.findall(r"/cell=(\d+)/", file)[-1]), 0, ids, np.frombuffer(m).reshape(len(ids), -1)

        for cell, _, block in steps(parts(), "cosine"):
            for _, probed, best in tiles:
                of = np.flatnonzero(probed[:, cell])
                if len(of):
                    best.add(block, of)
        for own, _, best in tiles:
            best.merge()
            yield _rows([(own[best.r], best.ids, best.s)], ["qid", "doc_num", "score"], [np.int64, np.int64, np.float64])

    found = over(_flat(queries, "qid", vec), "id", max(TILE, min(ASKED, PLACES // k)), run, "qid bigint, doc_num bigint, score double")
    return ranked(found, ["qid"], k).select("qid", "rank", "doc_num", "score")
