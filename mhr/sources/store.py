"""Versioned document store as tables: an operation log, latest-wins views, tombstones, compaction, backup.

A log row is (seq, op, key, ts, payload, crc); op is insert, update or delete.  Sequence numbers, not file times, decide
which row is latest, so compaction never changes what a reader sees.
"""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import numbered

LOG = "seq bigint, op string, key string, ts bigint, payload string, crc bigint"


def crc_of(payload: Column) -> Column:
    return F.crc32(F.coalesce(payload, F.lit("")).cast("binary"))


def log_rows(df: DataFrame, seq: Column, op: Column, key: Column, ts: Column, payload: Column) -> DataFrame:
    """A log from any table."""
    cols = {"seq": seq.cast("bigint"), "op": op, "key": key.cast("string"), "ts": ts.cast("bigint"), "payload": payload}
    return df.select(*[c.alias(n) for n, c in cols.items()]).withColumn("crc", crc_of(F.col("payload")))


def replay(log: DataFrame, strict: bool = True) -> DataFrame:
    """Rows of a log whose checksum holds; strict: only those before the first bad one."""
    good = log.where(F.col("crc") == crc_of(F.col("payload")))
    if not strict:
        return good
    bad = log.where(~F.col("crc").eqNullSafe(crc_of(F.col("payload")))).agg(F.min("seq").alias("_bad"))
    return good.crossJoin(F.broadcast(bad)).where(F.col("_bad").isNull() | (F.col("seq") < F.col("_bad"))).drop("_bad")  # one row


def latest(log: DataFrame, live: bool = True, *order: str) -> DataFrame:
    """The row of greatest `order` (seq, unless given) of each key; without deleted keys, unless asked for.  One map-side
    combined aggregation."""
    by = F.struct(*order) if order else F.col("seq")
    last = log.groupBy("key").agg(F.max_by(F.struct(*[c for c in log.columns if c != "key"]), by).alias("r")).select("key", "r.*")
    return last.where(F.col("op") != "delete") if live else last


def tagged(records: DataFrame, collection: str) -> DataFrame:
    """Records whose tags name the collection."""
    return records.where(F.array_contains("tags", f"collection:{collection}"))


def entries_from_map(spark: SparkSession, values: Mapping[str, str], ts: int) -> DataFrame:
    """(key, value, ts, deleted) entries of one stamp."""
    return spark.createDataFrame([(k, v, ts, False) for k, v in sorted(values.items())], "key string, value string, ts bigint, deleted boolean")


def write_sorted(df: DataFrame, path: str, key: str = "key", mode: str = "append") -> None:
    """Files sorted by key: their min-max statistics prune lookups and ranges."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode(mode).parquet(path)


def write_table(df: DataFrame, path: str, key: str = "key") -> dict:
    """`write_sorted` once, with a checksum beside the folder that `open_table` verifies."""
    write_sorted(df, path, key, "errorifexists")
    made = {"version": 2, "rows": df.sparkSession.read.parquet(path).count(), "checksum": checksum(df.sparkSession.read.schema(df.schema).parquet(path))}
    put_text(df.sparkSession, f"{path}.checksum.json", json.dumps(made))
    return made


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of `write_table`, or an older one without a checksum; ValueError if rows don't match it."""
    df = spark.read.parquet(path)
    if exists(spark, f"{path}.checksum.json"):
        told = json.loads(get_text(spark, f"{path}.checksum.json"))
        if (told["rows"], told["checksum"]) != (df.count(), checksum(df)):
            raise ValueError(f"{path} is damaged")
    return df


def flush(memory: DataFrame, path: str, threshold: int = 1000) -> bool:
    """Writes a memory table as one more sorted file set once it has `threshold` rows."""
    if memory.count() < threshold:
        return False
    write_sorted(memory, path)
    return True


def get(table: DataFrame, key: str) -> DataFrame:
    """Rows of a key; of a log the latest, if it isn't deleted."""
    found = table.where(F.col("key") == key)
    return latest(found) if {"seq", "op"} <= set(table.columns) else found


class BlockCache:
    """Blocks read before, by least recent use: at most `capacity` of them and `budget` bytes."""

    def __init__(self, load: Callable[[str], bytes | None], capacity: int = 50_000, budget: int = 50 << 20):
        self.load, self.capacity, self.budget = load, capacity, budget
        self.blocks: OrderedDict[str, bytes | None] = OrderedDict()
        self.used = self.hits = self.misses = self.evictions = 0

    def get(self, key: str) -> bytes | None:
        if key in self.blocks:
            self.hits += 1
            self.blocks.move_to_end(key)
            return self.blocks[key]
        self.misses += 1
        block = self.load(key)
        self.blocks[key], self.used = block, self.used + len(block or b"")
        while len(self.blocks) > self.capacity or self.used > self.budget and len(self.blocks) > 1:
            self.used -= len(self.blocks.popitem(last=False)[1] or b"")
            self.evictions += 1
        return block


class VectorTable:
    """Vectors (head, doc_num, vec) in a folder a head: one writer for saving, appending, compacting and reading.

    Rows have seq, the order of insertion; of a (head, doc_num) the last one counts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, vectors: DataFrame, seq: int = 0) -> None:
        """One append, all or nothing; rows of a greater seq win.  A head that is new makes its folder."""
        rows = vectors.select("head", F.col("doc_num").cast("bigint").alias("doc_num"), F.col("vec").cast("array<float>").alias("vec"), F.lit(seq).cast("bigint").alias("seq"))
        rows.repartition("head", F.pmod(F.xxhash64("doc_num"), F.lit(64))).write.mode("append").partitionBy("head").parquet(self.path)

    save_all = append

    def all(self) -> DataFrame:
        return self.spark.read.schema("doc_num bigint, vec array<float>, seq bigint, head string").parquet(self.path)

    def load(self) -> DataFrame:
        """(head, doc_num, vec, seq), the last of each."""
        last = self.all().groupBy("head", "doc_num").agg(F.max_by(F.struct("vec", "seq"), "seq").alias("r"))
        return last.select("head", "doc_num", "r.vec", "r.seq")

    def read_head(self, head: str) -> DataFrame:
        """Only that head's folder is read."""
        return self.load().where(F.col("head") == head).select("doc_num", "vec", "seq")

    def compact(self, fresh: str) -> VectorTable:
        """The last rows alone, as a table at `fresh`; the old one stays until its reader has gone over."""
        out = VectorTable(self.spark, fresh)
        self.load().repartition("head", F.pmod(F.xxhash64("doc_num"), F.lit(64))).write.partitionBy("head").parquet(out.path)
        return out


def scan_range(table: DataFrame, start: str, end: str) -> DataFrame:
    """Half-open range of keys."""
    return table.where((F.col("key") >= start) & (F.col("key") < end))


def compact(files: Sequence[DataFrame] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): latest ts of each key over files in order, the earlier file on ties; tombstones go.

    Either a list of tables (key, value, ts, deleted), or one with a column file that orders them.
    """
    if isinstance(files, DataFrame):
        rows = files
    else:
        rows = None
        for i, f in enumerate(files):
            one = f.withColumn("file", F.lit(i))
            rows = one if rows is None else rows.unionByName(one)
    last = rows.groupBy("key").agg(F.max_by(F.struct("value", "ts", "deleted"), F.struct("ts", -F.col("file"))).alias("r")).select("key", "r.*")
    counts = last.agg(F.count(F.when(~F.col("deleted"), 1)).alias("kept"), F.count(F.when(F.col("deleted"), 1)).alias("tombstones_removed"))
    return last.where(~F.col("deleted")).drop("deleted"), counts


def with_numbers(ids: DataFrame, known: DataFrame | None = None, id_col: str = "id", order: str = "seq") -> DataFrame:
    """(id, doc_num): known numbers stay, new ids get the next ones in order of first insertion.

    Numbers come from counts of range partitions, so no task sees all ids.  Runs jobs while the result is built.
    """
    new = ids.groupBy(id_col).agg(F.min(order).alias("_o"))
    start = 0
    if known is not None:
        new = new.join(known.select(id_col), id_col, "left_anti")
        start = known.agg(F.max("doc_num")).first()[0] or 0
    out = numbered(new, "_o", id_col).select(id_col, (F.col("_n") + start + 1).alias("doc_num"))
    return out if known is None else known.select(id_col, "doc_num").unionByName(out)


def field_heads(fields: DataFrame, col: str = "fields") -> DataFrame:
    """Adds k_vecs: fields that parse as vectors, named by their head (a suffix _vector, _embedding or _head goes)."""
    from mhr.functions.vectors import parse_vector

    entries = F.filter(F.transform(F.map_entries(col), lambda e: F.struct(F.when(F.regexp_like(e.key, F.lit("_(vector|embedding|head)$")), F.split_part(e.key, F.lit("_"), F.lit(1))).otherwise(e.key).alias("key"), parse_vector(e.value).alias("value"))), lambda e: e.value.isNotNull())
    return fields.withColumn("k_vecs", F.map_from_entries(F.array_distinct(entries)))


def searchable_text(col: str = "fields") -> Column:
    """Values of fields that aren't vectors, in order of their names."""
    from mhr.functions.vectors import parse_vector

    plain = F.filter(F.array_sort(F.map_entries(col)), lambda e: parse_vector(e.value).isNull())
    return F.array_join(F.transform(plain, lambda e: e.value), " ")


def checksum(df: DataFrame) -> int:
    """Order-free checksum of a table."""
    return df.agg(F.coalesce(F.sum(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 31))), F.lit(0))).first()[0]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file under another name and renames it, so that no reader sees half of it."""
    fs, p = _fs(spark, path)
    _, tmp = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(tmp, p):
        fs.delete(tmp, False)
        raise OSError(f"can't write {path}")


def get_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def claim(spark: SparkSession, folder: str, first: int = 1) -> int:
    """The next number that nobody has: an empty file of that name is made, which only one writer can."""
    fs, p = _fs(spark, folder)
    fs.mkdirs(p)
    n = max([first - 1, *(int(s.getPath().getName()) for s in fs.listStatus(p))]) + 1
    while not fs.createNewFile(_fs(spark, f"{folder}/{n}")[1]):
        n += 1
    return n


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def backup(spark: SparkSession, tables: dict[str, str], folder: str, name: str) -> dict:
    """Copies tables (name -> path) to folder/name with a manifest of rows and checksums."""
    made: dict = {"name": name, "tables": {}}
    for t, path in tables.items():
        df = spark.read.parquet(path)
        df.write.parquet(f"{folder}/{name}/{t}")
        made["tables"][t] = {"rows": df.count(), "checksum": checksum(df)}
    spark.createDataFrame([(json.dumps(made),)], "value string").coalesce(1).write.text(f"{folder}/{name}/_manifest")
    return made


def backups(spark: SparkSession, folder: str) -> list[str]:
    """Names, newest first."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    found = [(s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(p) if s.isDirectory()]
    return [n for _, n in sorted(found, reverse=True)]


def restore(spark: SparkSession, folder: str, name: str, tables: dict[str, str]) -> dict:
    """Checks rows and checksums of every table, then overwrites the targets; ValueError leaves them as they are."""
    manifest = json.loads(spark.read.text(f"{folder}/{name}/_manifest").first()[0])
    for t in tables:
        df, told = spark.read.parquet(f"{folder}/{name}/{t}"), manifest["tables"].get(t)
        if told is None or told != {"rows": df.count(), "checksum": checksum(df)}:
            raise ValueError(f"backup {name}: table {t} is missing or damaged")
    for t, path in tables.items():
        spark.read.parquet(f"{folder}/{name}/{t}").write.mode("overwrite").parquet(path)
    return manifest


class Transaction:
    """Operations staged in order and written as one append, which is all or nothing."""

    def __init__(self, spark: SparkSession, path: str, first_seq: int):
        self.spark, self.path, self.seq = spark, path, first_seq
        self.rows: list[tuple] = []

    def record(self, op: str, key: str, payload: str | None = None, ts: int = 0) -> None:
        if op not in ("insert", "update", "delete"):
            raise ValueError(f"unknown operation {op}")
        self.rows.append((self.seq + len(self.rows), op, key, ts, payload))

    def rollback(self) -> None:
        self.rows.clear()

    def commit(self) -> int:
        n = len(self.rows)
        if n:
            staged = self.spark.createDataFrame(self.rows, "seq bigint, op string, key string, ts bigint, payload string")
            staged.withColumn("crc", crc_of(F.col("payload"))).coalesce(1).write.mode("append").parquet(self.path)
        self.seq += n
        self.rows.clear()
        return n
