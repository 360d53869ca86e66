"""Vector benchmark files: records of a little-endian int32 dimension and as many float32 values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vectors of one read: a file of any length is read in parallel, a range a task.
RANGE = 65_536


def read_fvecs(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(doc_num, vec ARRAY<FLOAT>) in file order; a file whose records aren't of `dim` raises, an empty one has no rows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    record = 4 * (dim + 1)
    if size % record:
        raise ValueError(f"{path} has {size} bytes, no multiple of {record}")
    count = size // record
    uri = path if ":" in path.split("/")[0] else f"file://{path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, name = FileSystem.from_uri(uri)
        for b in batches:
            for first in b.column(0).to_pylist():
                with fs.open_input_file(name) as f:
                    f.seek(first * record)
                    raw = np.frombuffer(f.read(min(RANGE, count - first) * record), "<i4").reshape(-1, dim + 1)
                if (raw[:, 0] != dim).any():
                    raise ValueError(f"{path}: a record isn't of dimension {dim}")
                values = raw[:, 1:].copy().view("<f4").reshape(-1)
                lists = pa.ListArray.from_arrays(np.arange(len(raw) + 1, dtype=np.int32) * dim, values)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(raw))), lists], ["doc_num", "vec"])

    starts = spark.range(0, max(count, 0), RANGE, numPartitions=max(1, min(10_000, -(-count // RANGE))))
    return starts.mapInArrow(run, "doc_num bigint, vec array<float>")


def write_fvecs(vectors: DataFrame, path: str) -> int:
    """One file of all vectors in order of doc_num, written by the driver a part at a time; their number.  For benchmark files."""
    from .store import _fs

    fs, p = _fs(vectors.sparkSession, path)
    out, n = fs.create(p, False), 0
    for row in vectors.orderBy("doc_num").select("vec").toLocalIterator():
        v = np.asarray(row[0], "<f4")
        out.write(bytearray(np.int32(len(v)).astype("<i4").tobytes() + v.tobytes()))
        n += 1
    out.close()
    return n


def split(vectors: DataFrame, share: float = 0.1, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(base, queries) by an MD5 of seed and id, the same in any engine."""
    key = F.concat_ws(":", F.lit(str(seed)), F.col("doc_num").cast("string"))
    u = F.conv(F.substring(F.md5(key.cast("binary")), 1, 10), 16, 10).cast("bigint") / float(1 << 40)
    return vectors.where(u >= share), vectors.where(u < share)


def dataset(spark: SparkSession, path: str, dim: int, k: int = 100, share: float = 0.1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, queries, truth) of a vector file: a tenth of it asks, truth (qid, rank, doc_num, score) are the k nearest of the
    base by exact search, the score being the negative squared distance."""
    from mhr.operators.search import knn

    base, asked = split(read_fvecs(spark, path, dim), share)
    asked = asked.withColumnRenamed("doc_num", "qid")
    return base, asked, knn(base, asked, k, "l2").withColumn("score", -F.col("score") * F.col("score"))
