"""Collections as tables in a folder: create, alter, insert, delete, search, and statements."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mhr.operators import bm25, fusion, ivf
from mhr.operators.search import head_lists, page, ranked, weight_of
from mhr.sources import store

from . import lang

LIMITS = {"top_k": 10_000, "heads": 32, "dimension": 4096, "fields": 256, "key": 256, "value": 1 << 20, "page": 1000}
_DOCS = "seq bigint, op string, key string, ts bigint, payload string, crc bigint, commit bigint"


def checked_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,128}", name):
        raise ValueError(f"bad collection name {name!r}")
    return name


def checked_heads(heads: Sequence[str]) -> list[str]:
    if len(heads) > LIMITS["heads"] or any(not re.fullmatch(r"[A-Za-z0-9_]{1,64}", h) for h in heads):
        raise ValueError("at most 32 heads of 1 to 64 letters, digits and _")
    return list(heads)


def checked_fields(fields: Mapping[str, str]) -> dict[str, str]:
    if len(fields) > LIMITS["fields"] or any(not 1 <= len(k.encode()) <= LIMITS["key"] or len(v.encode()) > LIMITS["value"] for k, v in fields.items()):
        raise ValueError("too many fields, or one too long")
    return dict(fields)


def checked_range(what: str, n: int) -> int:
    if not 1 <= n <= LIMITS[what]:
        raise ValueError(f"{what} must be 1 to {LIMITS[what]}")
    return n


class Engine:
    """Everything is under `folder`, in a folder a collection: catalog versions, numbered commits of the log of field maps, and
    of single vectors.  A restart is a read.

    A writer claims a number, writes its commit and so finishes it; readers take finished commits alone, in order of their
    numbers.  So writers don't share numbers, nor scan the log for them, and nothing half-written is seen.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.counts = spark, folder.rstrip("/"), Counter()

    # ---- catalog

    def _path(self, name: str, what: str) -> str:
        return f"{self.folder}/{checked_name(name)}/{what}"

    def _write_catalog(self, name: str, entry: dict) -> None:
        n = store.claim(self.spark, self._path(name, "catalog-claims"))
        store.put_text(self.spark, self._path(name, f"catalog/{n:08}.json"), json.dumps(entry))

    def get_collection(self, name: str) -> dict:
        versions = [v for v in store.names(self.spark, self._path(name, "catalog")) if v.endswith(".json")]
        if not versions:
            raise ValueError(f"no collection {name}")
        return json.loads(store.get_text(self.spark, self._path(name, f"catalog/{versions[-1]}")))

    def create_collection(self, name: str, dimension: int = 64, settings: lang.Settings | None = None, per_head: Mapping[str, lang.Settings] | None = None, fields: Sequence[tuple[str, str]] = ()) -> None:
        checked_range("dimension", dimension)
        if store.exists(self.spark, self._path(name, "catalog")):
            raise ValueError(f"collection {name} exists")
        self._write_catalog(name, {"dimension": dimension, "settings": asdict(settings or lang.Settings()), "per_head": {h: asdict(s) for h, s in (per_head or {}).items()}, "fields": list(fields), "heads": {}, "removed": [], "gating": None})

    def alter_collection(self, name: str, settings: lang.Settings, per_head: Mapping[str, lang.Settings] | None = None) -> None:
        """Replaces all settings; those not named are back at their defaults."""
        entry = self.get_collection(name)
        self._write_catalog(name, entry | {"settings": asdict(settings), "per_head": {h: asdict(s) for h, s in (per_head or {}).items()}})

    def settings_of(self, name: str, head: str) -> lang.Settings:
        """A head's own settings, else the collection's."""
        entry = self.get_collection(name)
        return lang.Settings(**entry["per_head"].get(head, entry["settings"]))

    def add_head(self, name: str, head: str, head_type: str = "semantic", weight: float = 1.0, settings: lang.Settings | None = None) -> None:
        """Registers a head, or changes it; it may have settings of its own."""
        entry = self.get_collection(name)
        checked_heads([*{*entry["heads"], head}])
        own = {head: asdict(settings)} if settings else {}
        self._write_catalog(name, entry | {"heads": entry["heads"] | {head: {"type": head_type, "dimension": entry["dimension"], "weight": weight}}, "per_head": entry["per_head"] | own, "removed": [h for h in entry["removed"] if h != head]})

    def remove_head(self, name: str, head: str) -> None:
        """The head is in no later list or search, until it is added again."""
        entry = self.get_collection(name)
        self._write_catalog(name, entry | {"heads": {h: x for h, x in entry["heads"].items() if h != head}, "removed": sorted({*entry["removed"], head})})

    def load_gating(self, name: str, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> None:
        """A gating network for searches without weights: softmax(W q + b), a row a head in order of their names."""
        self._write_catalog(name, self.get_collection(name) | {"gating": [[list(map(float, w)) for w in weights], list(map(float, bias))]})

    def list_collections(self) -> list[str]:
        return [n for n in store.names(self.spark, self.folder) if store.exists(self.spark, f"{self.folder}/{n}/catalog")]

    def delete_collection(self, name: str) -> None:
        store.remove(self.spark, f"{self.folder}/{checked_name(name)}")

    # ---- documents

    def _append(self, name: str, rows: DataFrame, op: str) -> int:
        """rows: (key, payload, n); one commit: all or nothing."""
        number = store.claim(self.spark, self._path(name, "claims"))
        log = store.log_rows(rows, F.col("n"), F.lit(op), F.col("key"), F.unix_micros(F.current_timestamp()) * 1000, F.col("payload"))
        log.withColumn("commit", F.lit(number).cast("bigint")).write.parquet(self._path(name, f"docs/commit-{number:012}"))
        self.counts[op] += 1
        return number

    def _finished(self, name: str) -> tuple[list[str], int]:
        """Folders to read (the latest base and the finished commits behind it), and up to which number all are finished."""
        found = [x for x in store.names(self.spark, self._path(name, "docs")) if store.exists(self.spark, self._path(name, f"docs/{x}/_SUCCESS"))]
        base = max((x for x in found if x.startswith("base-")), default=None)
        start = int(base[5:]) if base else 0
        commits = [x for x in found if x.startswith("commit-") and int(x[7:]) > start]
        upto = start
        while f"commit-{upto + 1:012}" in commits:
            upto += 1
        return [self._path(name, f"docs/{x}") for x in ([base] if base else []) + commits], upto

    def log(self, name: str) -> DataFrame:
        """All operations of finished commits, checksums verified."""
        self.get_collection(name)
        folders, _ = self._finished(name)
        if not folders:
            return self.spark.createDataFrame([], _DOCS)
        return store.replay(self.spark.read.schema(_DOCS).parquet(*folders), strict=False)

    def _checked(self, name: str, df: DataFrame) -> DataFrame:
        """Rows (key, payload, n) whose fields keep the limits; ValueError if any doesn't."""
        fields = F.from_json("payload", "map<string,string>")
        heads = store.field_heads(df.withColumn("fields", fields)).withColumn("v", F.map_values("k_vecs"))
        dim = self.get_collection(name)["dimension"]
        bad = F.when(F.col("key").isNull(), "a document has no id").when(F.size("fields") > LIMITS["fields"], "too many fields")
        bad = bad.when(F.exists(F.map_keys("fields"), lambda k: (F.octet_length(k) < 1) | (F.octet_length(k) > LIMITS["key"])), "a field's name is empty or too long")
        bad = bad.when(F.exists(F.map_values("fields"), lambda v: F.octet_length(v) > LIMITS["value"]), "a field is too long")
        bad = bad.when((F.size("v") == 0) | F.col("v").isNull() | F.exists("v", lambda x: F.size(x) != dim), f"a document has no vector, or one that isn't of dimension {dim}")
        first = heads.select(bad.alias("why")).where("why is not null").first()
        if first:
            raise ValueError(first.why)
        return df

    def insert(self, name: str, docs: Mapping[int, Mapping[str, str]]) -> None:
        """Fields that parse as vectors become heads; each document needs one, of the collection's dimension."""
        rows = [(str(int(i)), json.dumps(checked_fields(f)), n) for n, (i, f) in enumerate(docs.items())]
        df = self.spark.createDataFrame(rows, "key string, payload string, n bigint")
        self._append(name, self._checked(name, df), "insert")

    def insert_table(self, name: str, docs: DataFrame, id_col: str = "doc_num", fields_col: str = "fields") -> None:
        """Bulk insert of (id, fields MAP<STRING,STRING>), one commit, under the limits of `insert`; of an id's rows one wins."""
        rows = docs.select(F.col(id_col).cast("string").alias("key"), F.to_json(fields_col).alias("payload"), F.xxhash64(F.to_json(fields_col)).alias("n"))
        self._append(name, self._checked(name, rows), "insert")

    def update(self, name: str, i: int, fields: Mapping[str, str]) -> None:
        """Another version of one document."""
        df = self.spark.createDataFrame([(str(int(i)), json.dumps(checked_fields(fields)), 0)], "key string, payload string, n bigint")
        self._append(name, self._checked(name, df), "update")

    def insert_vector(self, name: str, head: str, i: int, vector: Sequence[float]) -> None:
        """A vector of one document in one head, which is registered if it isn't; it goes before a vector in the fields."""
        self.append_vectors(name, self.spark.createDataFrame([(head, int(i), [float(x) for x in vector])], "head string, doc_num bigint, vec array<double>"))

    def append_vectors(self, name: str, vectors: DataFrame) -> None:
        """Vectors (head, doc_num, vec) in bulk; all must be of the collection's dimension."""
        entry = self.get_collection(name)
        if vectors.where(F.size("vec") != entry["dimension"]).limit(1).count():
            raise ValueError(f"vectors must be of dimension {entry['dimension']}")
        heads = checked_heads([r[0] for r in vectors.select("head").distinct().limit(LIMITS["heads"] + 1).collect()])
        for head in heads:
            if head not in entry["heads"]:
                self.add_head(name, head)
        store.VectorTable(self.spark, self._path(name, "vectors")).append(vectors, store.claim(self.spark, self._path(name, "vector-claims")))

    def delete(self, name: str, *ids: int) -> None:
        """Tombstones; every later read and search leaves them out."""
        self._append(name, self.spark.createDataFrame([(str(i), None, n) for n, i in enumerate(ids)], "key string, payload string, n bigint"), "delete")

    def documents(self, name: str) -> DataFrame:
        """(doc_num, fields, k_vecs) of live documents, vectors of their own in place."""
        live = store.latest(self.log(name), True, "commit", "seq")
        docs = store.field_heads(live.select(F.col("key").cast("bigint").alias("doc_num"), F.from_json("payload", "map<string,string>").alias("fields")))
        if store.exists(self.spark, self._path(name, "vectors")):
            own = store.VectorTable(self.spark, self._path(name, "vectors")).load().groupBy("doc_num").agg(F.map_from_entries(F.collect_list(F.struct("head", F.col("vec").cast("array<double>")))).alias("own"))  # a row a head
            mixed = F.when(F.col("own").isNull(), F.col("k_vecs")).otherwise(F.map_concat(F.map_filter("k_vecs", lambda k, v: ~F.map_contains_key("own", k)), "own"))
            docs = docs.join(own, "doc_num", "left").withColumn("k_vecs", mixed).drop("own")
        return docs

    def get(self, name: str, i: int) -> DataFrame:
        """The document, or no row."""
        return self.documents(name).where(F.col("doc_num") == i)

    def list_heads(self, name: str) -> list[str]:
        entry = self.get_collection(name)
        found = {r[0] for r in self.documents(name).select(F.explode(F.map_keys("k_vecs"))).distinct().collect()}
        return sorted((found | {*entry["heads"]}) - {*entry["removed"]})

    def stats(self) -> list[tuple[str, int, int]]:
        """(collection, heads, vectors)"""
        out = []
        for name in self.list_collections():
            r = self.documents(name).select(F.explode(F.map_keys("k_vecs")).alias("h")).agg(F.countDistinct("h"), F.count("h")).first()
            out.append((name, r[0], r[1]))
        return out

    def is_persistent(self) -> bool:
        return store.exists(self.spark, self.folder)

    def flush(self) -> None:
        """Commits are written when they are made: nothing is left to do."""

    def health(self) -> dict:
        """Whether the engine is ready, with its counts and those of the operations of this session."""
        stats = self.stats() if self.is_persistent() else []
        total = {"collections": len(stats), "heads": sum(s[1] for s in stats), "vectors": sum(s[2] for s in stats)}
        return {"alive": True, "ready": self.is_persistent(), **total, "operations": dict(self.counts)}

    # ---- search

    def search(self, name: str, vector: Sequence[float], heads: Sequence[str] | None = None, top_k: int = 10, offset: int = 0, text: str | None = None, weights: Mapping[str, float] | None = None, min_weight: float | None = None, temporal_decay: float | None = None, where: Column | str | None = None, approximate: bool = False) -> DataFrame:
        """(rank, doc_num, score, fields, has_more): multi-head attend, with `text` fused with keywords by reciprocal rank.

        Each head is scored by its own similarity, and with `approximate` searched by cells as widely as its ef_search asks.
        `where` filters documents (doc_num, fields) before they are scored.
        """
        entry = self.get_collection(name)
        checked_range("top_k", top_k)
        if len(vector) != entry["dimension"]:
            raise ValueError(f"the query has {len(vector)} dimensions, the collection {entry['dimension']}")
        known = self.list_heads(name)
        asked = checked_heads(heads or known)
        there = [h for h in asked if h in known]
        if not there:
            raise ValueError("no heads available")
        docs = self.documents(name) if where is None else self.documents(name).where(where)
        query = self.spark.createDataFrame([(0, [float(x) for x in vector])], "qid bigint, q array<double>")
        want, lists = offset + top_k + 1, None
        wide = docs.select("doc_num", *[F.col("k_vecs")[h].alias(h) for h in there])
        own = {h: self.settings_of(name, h) for h in there}
        for metric in sorted({s.similarity for s in own.values()}):  # heads of one similarity in one pass
            mine = [h for h in there if own[h].similarity == metric]
            if approximate and metric == "cosine":
                for h in mine:
                    vectors = wide.select("doc_num", F.col(h).alias("vec"))
                    cells = ivf.fit(vectors)
                    one = ivf.search(ivf.index(vectors, cells), cells, query.withColumnRenamed("q", "vec"), fusion.fetch_count(want), own[h].ef_search)
                    one = one.select("qid", F.lit(h).alias("head"), "doc_num", "score", "rank")
                    lists = one if lists is None else lists.unionByName(one)
            else:
                one = head_lists(wide, query.select("qid", *[F.col("q").alias(h) for h in mine]), mine, fusion.fetch_count(want), metric)
                lists = one if lists is None else lists.unionByName(one)
        if weights is not None:
            w = weight_of(F.col("head"), dict(weights))
        elif entry["gating"]:
            lists = lists.join(fusion.gate(query, *entry["gating"], asked, "q"), ["qid", "head"])
            w = F.col("gate")
        else:
            w = F.lit(1.0 / len(asked))
        if temporal_decay is not None:
            w = F.when(F.col("head") == "temporal", w * float(temporal_decay)).otherwise(w)
        lists = fusion.max_normalised(lists)
        if min_weight is not None:
            lists = lists.where(w >= min_weight)
        hits = fusion.fuse(lists, w, want if text is None else fusion.fetch_count(want))
        if text is not None:
            searched = docs.select(F.col("doc_num").alias("doc_id"), store.searchable_text().alias("text"))
            terms = bm25.tokens(self.spark.createDataFrame([(0, text)], "doc_id bigint, text string"), stem=True).withColumnRenamed("doc_num", "qid")
            hits = fusion.attend_hybrid(hits, bm25.search(searched, terms, fusion.fetch_count(want), stem=True), want)
        self.counts["search"] += 1
        out = page(ranked(hits.drop("rank"), ["qid"], want), offset, top_k)
        return out.join(docs.select("doc_num", "fields"), "doc_num", "left").select("rank", "doc_num", "score", F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"), "has_more").orderBy("rank")

    def run_statement(self, text: str, vector: Sequence[float] | None = None) -> DataFrame | dict | None:
        s = lang.parse(text)
        if isinstance(s, lang.Create):
            return self.create_collection(s.collection, settings=s.settings, per_head=s.per_head, fields=s.fields)
        if isinstance(s, lang.Alter):
            return self.alter_collection(s.collection, s.settings, s.per_head)
        if isinstance(s, lang.Show):
            return self.get_collection(s.collection)
        if vector is None:
            raise lang.StatementError("ATTEND needs a query vector")
        heads = None if s.heads in ((), ("default",)) else s.heads
        return self.search(s.collection, vector, heads, s.top_k, weights=None, min_weight=s.min_weight, temporal_decay=s.decay)

    # ---- admin

    def compact(self, name: str) -> int:
        """Writes the latest live rows of all commits up to the first unfinished one as a base, sorted by key; rows in it.

        Readers go over to the base once it is finished; only then are the commits and bases before it deleted.
        """
        folders, upto = self._finished(name)
        folders = [x for x in folders if "/base-" in x or int(x.rpartition("-")[2]) <= upto]
        base = self._path(name, f"docs/base-{upto:012}")
        if not folders or folders == [base]:
            return self.documents(name).count()
        log = store.replay(self.spark.read.schema(_DOCS).parquet(*folders), strict=False)
        store.write_sorted(store.latest(log, True, "commit", "seq").select(*[c.split()[0] for c in _DOCS.split(", ")]), base, mode="overwrite")
        for old in folders:
            store.remove(self.spark, old)
        return self.spark.read.schema(_DOCS).parquet(base).count()

    def backup(self, name: str, folder: str, label: str) -> dict:
        """The operations of all finished commits, with their number and checksum."""
        self.log(name).write.parquet(f"{folder}/{label}-rows")
        made = store.backup(self.spark, {"docs": f"{folder}/{label}-rows"}, folder, label)
        store.remove(self.spark, f"{folder}/{label}-rows")
        return made

    def backups(self, folder: str) -> list[str]:
        return store.backups(self.spark, folder)

    def restore(self, name: str, folder: str, label: str) -> dict:
        """The collection's documents as they were: verified, then written as a base that everything before it gives way to."""
        number = store.claim(self.spark, self._path(name, "claims"))
        base = self._path(name, f"docs/base-{number:012}")
        made = store.restore(self.spark, folder, label, {"docs": base})
        for x in store.names(self.spark, self._path(name, "docs")):
            if x.rpartition("-")[2] < f"{number:012}":
                store.remove(self.spark, self._path(name, f"docs/{x}"))
        return made

    def transaction(self, name: str) -> Batch:
        return Batch(self, name)


class Batch:
    """Operations on one collection, staged in order and written as one commit, or dropped."""

    def __init__(self, engine: Engine, name: str):
        self.engine, self.name, self.rows = engine, name, []

    def insert(self, i: int, fields: Mapping[str, str]) -> None:
        self.rows.append(("insert", str(int(i)), json.dumps(checked_fields(fields))))

    def delete(self, i: int) -> None:
        self.rows.append(("delete", str(int(i)), None))

    def rollback(self) -> None:
        self.rows.clear()

    def commit(self) -> int:
        """How many operations were written."""
        rows, e = [(op, k, p, n) for n, (op, k, p) in enumerate(self.rows)], self.engine
        self.rows.clear()
        if rows:
            df = e.spark.createDataFrame(rows, "op string, key string, payload string, n bigint")
            e._checked(self.name, df.where("op = 'insert'").drop("op"))
            number = store.claim(e.spark, e._path(self.name, "claims"))
            log = store.log_rows(df, F.col("n"), F.col("op"), F.col("key"), F.unix_micros(F.current_timestamp()) * 1000, F.col("payload"))
            log.withColumn("commit", F.lit(number).cast("bigint")).write.parquet(e._path(self.name, f"docs/commit-{number:012}"))
        return len(rows)
