"""Tables in the folder that all executors share: they cut lineage, and a lost executor loses nothing of them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is named and the master is this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="mhr-")
    spark.conf.set("spark.checkpoint.dir", own)
    atexit.register(shutil.rmtree, own.removeprefix("file://"), ignore_errors=True)
    return own


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet; it is deleted when the driver ends, or by `forget`."""
    path = f"{shared_dir(spark)}/mhr/{what}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes `df` once into the shared folder and reads it back."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the list of stored tables, for `forget`."""
    return len(_written)


def forget(since: int = 0) -> None:
    """Deletes the tables stored since `mark`; a long-lived driver calls it once their results are written."""
    from pyspark import SparkContext

    sc, gone = SparkContext._active_spark_context, _written[since:]
    del _written[since:]
    if sc is None or sc._jsc is None:
        return
    for path in gone:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _at_end() -> None:
    try:
        forget()
    except Exception:  # noqa: BLE001 - the JVM has gone: the cluster clears its folder
        return


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds _n, each row's place from 0 in the order of the columns (which should tell rows apart), and _p, its part.

    Rows are range-partitioned, written once and read for both the parts' sizes and the places, so places neither repeat
    nor leave gaps, and no task sees more than its part.
    """
    local = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", local), "numbered")
    before, total = [], 0
    for p, n in sorted(placed.groupBy("_p").count().collect()):  # one row a part
        before.append((p, total))
        total += n
    start = df.sparkSession.createDataFrame(before, "_p int, _b bigint")
    return placed.join(F.broadcast(start), "_p").withColumn("_n", F.col("_b") + F.col("_i")).drop("_i", "_b")
