"""Registered queries of collections, stores, translations, workloads and reports, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mhr.functions import vectors as V
from mhr.functions.text import stem
from mhr.operators import fusion, ivf, learn, metrics, search, shard, translate, workload
from mhr.sources import fvecs, sinks, store
from mhr.sources.shared import new_path

from . import lang
from .registry import COS2, HEADS, OUT, V_SQL, asking, attend_sql, event_log, fused_sql, gappy, knn_sql, label_quality, lists_sql, plain, query, shown, table, wide
from .session import Engine

# ---- collections


def written(vec):
    return F.concat(F.lit("["), F.array_join(vec.cast("array<double>").cast("array<string>"), ","), F.lit("]"))


def fields_of(spark, sf) -> DataFrame:
    """A map of fields for each vector: a title, and the vector as text in two heads (one for ids divisible by 4)."""
    e = table(spark, sf, "embeddings")
    title = F.concat(F.lit("paper "), F.col("vec_id").cast("string"), F.lit(" of class "), F.col("label").cast("string"))
    two = F.create_map(F.lit("title"), title, F.lit("semantic_vector"), written(F.col("embedding")), F.lit("temporal_vector"), written(F.reverse("embedding")))
    one = F.create_map(F.lit("title"), title, F.lit("semantic_vector"), written(F.col("embedding")))
    return e.select(F.col("vec_id").alias("doc_num"), F.when(F.col("vec_id") % 4 == 0, one).otherwise(two).alias("fields"))


def filled(spark, sf, name: str = "papers") -> Engine:
    """An engine with one collection: all vectors inserted, ids 3, 5 and 8 deleted, 8 inserted again, 10 updated."""
    e = Engine(spark, new_path(spark, "engine"))
    e.create_collection(name)
    e.insert_table(name, fields_of(spark, sf))
    e.delete(name, 3, 5, 8)
    again = [float(i == 1) for i in range(64)]
    e.insert(name, {8: {"title": "back", "semantic_vector": str(again)}})
    e.update(name, 10, {"title": "second version", "semantic_vector": str(again)})
    return e


def titles(docs: DataFrame) -> DataFrame:
    return docs.select("doc_num", F.col("fields")["title"].alias("title"), F.array_join(F.array_sort(F.map_keys("k_vecs")), " ").alias("heads"))


TITLES = """SELECT vec_id AS doc_num, CASE vec_id WHEN 8 THEN 'back' WHEN 10 THEN 'second version' ELSE 'paper ' || vec_id || ' of class ' || label END AS title,
  CASE WHEN vec_id % 4 = 0 OR vec_id = 10 THEN 'semantic' ELSE 'semantic temporal' END AS heads FROM embeddings WHERE vec_id NOT IN (3, 5)"""


@query(TITLES)
def engine_documents(spark, sf):
    """Bulk and single inserts, deletes and updates: what lives."""
    return titles(filled(spark, sf).documents("papers"))


@query(TITLES)
def engine_after_restart(spark, sf):
    e = filled(spark, sf)
    return titles(Engine(spark, e.folder).documents("papers"))


@query(TITLES)
def engine_compacted(spark, sf):
    """The log rewritten as a base; one more commit counts on top of it."""
    e = filled(spark, sf)
    e.delete("papers", 10)
    e.compact("papers")
    e.update("papers", 10, {"title": "second version", "semantic_vector": str([1.0] + [0.0] * 63)})
    return titles(e.documents("papers"))


@query(TITLES)
def engine_restored(spark, sf):
    """Backed up, spoilt, and restored."""
    e = filled(spark, sf)
    e.backup("papers", new_path(spark, "backups"), "one")
    folder = new_path(spark, "backups")
    e.backup("papers", folder, "two")
    e.delete("papers", *range(50))
    e.restore("papers", folder, "two")
    return titles(e.documents("papers"))


@query("SELECT name FROM (VALUES ('one'), ('two')) t(name)")
def engine_backups(spark, sf):
    e, folder = filled(spark, sf), new_path(spark, "backups")
    for name in ("one", "two"):
        e.backup("papers", folder, name)
    return spark.createDataFrame([(n,) for n in e.backups(folder)], "name string")


@query("SELECT vec_id AS doc_num, 'paper ' || vec_id || ' of class ' || label AS title FROM embeddings WHERE vec_id = 7")
def engine_get(spark, sf):
    """One document by its id; a deleted one gives no row."""
    e = filled(spark, sf)
    found = e.get("papers", 7).unionByName(e.get("papers", 3))
    return found.select("doc_num", F.col("fields")["title"].alias("title"))


@query(f"WITH base AS ({TITLES}) SELECT doc_num, title, heads FROM base WHERE doc_num NOT IN (1, 2) UNION ALL SELECT 2, 'staged', 'semantic'")
def engine_transaction(spark, sf):
    """A batch committed as one, another rolled back."""
    e = filled(spark, sf)
    t = e.transaction("papers")
    t.delete(1)
    t.insert(2, {"title": "staged", "semantic_vector": str([1.0] * 64)})
    t.commit()
    t.delete(9)
    t.rollback()
    t.commit()
    return titles(e.documents("papers"))


@query("SELECT 'papers' AS collection, heads, vectors FROM (SELECT 2::BIGINT AS heads, (sum(CASE WHEN vec_id % 4 = 0 OR vec_id = 10 THEN 1 ELSE 2 END))::BIGINT AS vectors FROM embeddings WHERE vec_id NOT IN (3, 5))")
def engine_collection_stats(spark, sf):
    return spark.createDataFrame(filled(spark, sf).stats(), "collection string, heads bigint, vectors bigint")


@query("SELECT true AS ready, 1 AS collections, 2::BIGINT AS heads, (sum(CASE WHEN vec_id % 4 = 0 OR vec_id = 10 THEN 1 ELSE 2 END))::BIGINT AS vectors, 2 AS inserts, 1 AS deletes FROM embeddings WHERE vec_id NOT IN (3, 5)")
def engine_health(spark, sf):
    h = filled(spark, sf).health()
    return spark.createDataFrame([(h["ready"], h["collections"], h["heads"], h["vectors"], h["operations"]["insert"], h["operations"]["delete"])], "ready boolean, collections int, heads bigint, vectors bigint, inserts int, deletes int")


@query("SELECT unnest(['added', 'semantic', 'single']) AS head")
def engine_heads(spark, sf):
    """Heads found in documents, one registered, one made by a vector, one removed."""
    e = filled(spark, sf)
    e.add_head("papers", "added", weight=0.5)
    e.insert_vector("papers", "single", 7, [0.5] * 64)
    e.remove_head("papers", "temporal")
    return spark.createDataFrame([(h,) for h in e.list_heads("papers")], "head string")


@query("SELECT vec_id AS doc_num, CASE WHEN vec_id % 2 = 0 THEN 'extra semantic' ELSE 'semantic' END || CASE WHEN vec_id % 4 > 0 AND vec_id <> 10 THEN ' temporal' ELSE '' END AS heads FROM embeddings WHERE vec_id NOT IN (3, 5)")
def engine_appended_vectors(spark, sf):
    """A head appended in bulk to every second document."""
    e = filled(spark, sf)
    more = table(spark, sf, "embeddings").where("vec_id % 2 = 0").select(F.lit("extra").alias("head"), F.col("vec_id").alias("doc_num"), F.col("embedding").alias("vec"))
    e.append_vectors("papers", more)
    return titles(e.documents("papers")).drop("title")


def engine_lists_sql(temporal: str, w: str = "0.5", where: str = "true", k: int = 10) -> str:
    """Both heads of the filled collection against vector 7, the temporal one by the measure given."""
    one_hot = "list_transform(range(64), lambda j: (j = 1)::INT::DOUBLE)"
    return f"""WITH q AS (SELECT 0 AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 7),
hv AS (SELECT vec_id AS doc_num, 'semantic' AS head, CASE WHEN vec_id IN (8, 10) THEN {one_hot} ELSE embedding::DOUBLE[] END AS vec FROM embeddings WHERE vec_id NOT IN (3, 5) AND {where}
  UNION ALL SELECT vec_id, 'temporal', list_reverse(embedding)::DOUBLE[] FROM embeddings WHERE vec_id NOT IN (3, 5, 10) AND vec_id % 4 > 0 AND {where}),
s AS (SELECT qid, head, doc_num, round(CASE head WHEN 'semantic' THEN list_cosine_similarity(qv, vec) ELSE {temporal} END, 9) AS score FROM q, hv),
l AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY score DESC, doc_num) AS rank FROM s QUALIFY rank <= {5 * (k + 1)}),
n AS (SELECT qid, head, doc_num, CASE WHEN max(score) OVER (PARTITION BY head) > 0 THEN score / max(score) OVER (PARTITION BY head) ELSE score END AS score FROM l),
{fused_sql(w, k)}
SELECT rank, doc_num, round(score, 9) AS score FROM r"""


def vector_7(spark, sf) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").where("vec_id = 7").first().embedding]


@query(engine_lists_sql("list_cosine_similarity(qv, vec)"))
def engine_search(spark, sf):
    return shown(filled(spark, sf).search("papers", vector_7(spark, sf)).select("rank", "doc_num", "score"))


@query(engine_lists_sql("list_dot_product(qv, vec)"))
def engine_per_head_settings(spark, sf):
    """The temporal head has its own similarity, which its list is made by."""
    e = filled(spark, sf)
    e.run_statement('ALTER COLLECTION papers SET (similarity = "cosine", temporal.similarity = "dot_product")')
    return shown(e.search("papers", vector_7(spark, sf)).select("rank", "doc_num", "score"))


@query(engine_lists_sql("list_cosine_similarity(qv, vec)", where="label < 5"))
def engine_filtered_search(spark, sf):
    """Documents filtered by a field before they are scored."""
    low = F.split_part(F.col("fields")["title"], F.lit("class "), F.lit(2)).cast("int")
    e = Engine(spark, new_path(spark, "engine"))
    e.create_collection("papers")
    e.insert_table("papers", fields_of(spark, sf))
    e.delete("papers", 3, 5)
    again = str([float(i == 1) for i in range(64)])
    labels = dict(table(spark, sf, "embeddings").where("vec_id in (8, 10)").select("vec_id", "label").collect())
    for i in (8, 10):
        e.update("papers", i, {"title": f"new of class {labels[i]}", "semantic_vector": again})
    return shown(e.search("papers", vector_7(spark, sf), where=low < 5).select("rank", "doc_num", "score"))


@query(engine_lists_sql("list_cosine_similarity(qv, vec)", "CASE head WHEN 'semantic' THEN 1 / (1 + exp(-1.0::DOUBLE)) ELSE 1 / (1 + exp(1.0::DOUBLE)) END"))
def engine_gated_search(spark, sf):
    """A gating network loaded into the collection: here its biases alone decide."""
    e = filled(spark, sf)
    e.load_gating("papers", [[0.0] * 64, [0.0] * 64], [1.0, 0.0])
    return shown(e.search("papers", vector_7(spark, sf)).select("rank", "doc_num", "score"))


@query(engine_lists_sql("list_cosine_similarity(qv, vec)", "0.5", k=5))
def engine_statement(spark, sf):
    return shown(filled(spark, sf).run_statement('ATTEND TO papers WHERE QUERY "x" TOP_K 5', vector_7(spark, sf)).select("rank", "doc_num", "score"))


@query("SELECT 'papers' AS collection, 100 AS ef, 'l2' AS similarity, 40 AS temporal_ef, 'l2' AS temporal_similarity")
def engine_settings(spark, sf):
    """Created, altered and shown by statements; a head overrides what it names."""
    e = Engine(spark, new_path(spark, "engine"))
    e.run_statement("CREATE COLLECTION papers (title TEXT) WITH (ef_search = 80)")
    e.run_statement('ALTER COLLECTION papers SET (ef_search = 100, similarity = "l2", temporal.ef_search = 40)')
    base, own = e.settings_of("papers", "semantic"), e.settings_of("papers", "temporal")
    return spark.createDataFrame([(e.list_collections()[0], base.ef_search, base.similarity, own.ef_search, own.similarity)], "collection string, ef int, similarity string, temporal_ef int, temporal_similarity string")


@query("SELECT name, ef, m, rerank FROM (VALUES ('default', 64, 16, true), ('high_recall', 256, 48, true), ('low_latency', 32, 12, false)) t(name, ef, m, rerank)")
def setting_presets(spark, sf):
    return spark.createDataFrame([(n, s.ef_search, s.max_connections, s.exact_rerank) for n, s in lang.PRESETS.items()], "name string, ef int, m int, rerank boolean")


@query("SELECT statement, rejected FROM (VALUES ('dimension 0', true), ('dimension 5000', true), ('name ../x', true), ('33 heads', true), ('top_k 0', true), ('no vector', true), ('short vector', true), ('long value', true), ('fine', false)) t(statement, rejected)")
def request_limits(spark, sf):
    """What validation turns down."""
    e = Engine(spark, new_path(spark, "engine"))
    e.create_collection("c", 4)
    v = "[1, 0, 0, 0]"
    tries = {
        "dimension 0": lambda: e.create_collection("d", 0),
        "dimension 5000": lambda: e.create_collection("d", 5000),
        "name ../x": lambda: e.create_collection("../x"),
        "33 heads": lambda: e.search("c", [1.0] * 4, [f"h{i}" for i in range(33)]),
        "top_k 0": lambda: e.search("c", [1.0] * 4, top_k=0),
        "no vector": lambda: e.insert("c", {1: {"title": "x"}}),
        "short vector": lambda: e.insert_table("c", spark.createDataFrame([(1, {"a_vector": "[1, 2]"})], "doc_num bigint, fields map<string,string>")),
        "long value": lambda: e.insert("c", {1: {"title": "x" * (1 << 20) + "y", "a_vector": v}}),
        "fine": lambda: e.insert("c", {1: {"title": "x", "a_vector": v}}),
    }
    out = []
    for what, run in tries.items():
        try:
            run()
            out.append((what, False))
        except ValueError:
            out.append((what, True))
    return spark.createDataFrame(out, "statement string, rejected boolean")


@query("SELECT k AS top_k, CASE WHEN k <= 5 THEN 32 WHEN k <= 20 THEN 64 ELSE 128 END AS ef, 3 * k AS candidates, 1.0::DOUBLE AS semantic, 0.5::DOUBLE AS temporal FROM (VALUES (5), (20), (21)) t(k)")
def attend_plans(spark, sf):
    out = []
    for k in (5, 20, 21):
        p = lang.plan(lang.parse(f'ATTEND TO d WHERE QUERY "q" HEADS [semantic, temporal] TOP_K {k} TEMPORAL_DECAY 0.5'))
        out.append((p.top_k, p.ef, p.candidates, p.weights["semantic"], p.weights["temporal"]))
    return spark.createDataFrame(out, "top_k int, ef int, candidates int, semantic double, temporal double")


# ---- vectors and files


def long_heads(spark, sf) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("head"), F.col(h).alias("vec")) for h in HEADS]))
    return wide(spark, sf).select("doc_num", each.alias("x")).select("x.head", "doc_num", "x.vec")


def marks(df: DataFrame) -> DataFrame:
    mark = F.aggregate(F.transform(V.doubles(F.col("vec")), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("mark", F.round(mark, 5)).drop("vec")


MARK = "round(list_sum(list_transform({}, lambda x, i: x::DOUBLE * i)), 5)"


@query(f"SELECT vec_id AS doc_num, (vec_id % 2)::BIGINT AS seq, CASE WHEN vec_id % 2 = 1 THEN {MARK.format('list_reverse(list_reverse(embedding))')} ELSE {MARK.format('list_reverse(embedding)')} END AS mark FROM embeddings")
def vector_table_head(spark, sf):
    """Heads saved in a folder each, every second vector appended again with another value: one head read, the last of each."""
    t = store.VectorTable(spark, new_path(spark, "vectors"))
    t.save_all(long_heads(spark, sf))
    t.append(long_heads(spark, sf).where("doc_num % 2 = 1").withColumn("vec", F.reverse("vec")), 1)
    return marks(t.read_head("temporal"))


@query(f"SELECT head, count(*) AS n, round(sum(mark), 3) AS total FROM (SELECT 'semantic' AS head, {MARK.format('embedding')} AS mark FROM embeddings UNION ALL SELECT 'temporal', {MARK.format('list_reverse(embedding)')} FROM embeddings UNION ALL SELECT 'structural', {MARK.format('list_concat(embedding[17:64], embedding[1:16])')} FROM embeddings) GROUP BY head")
def vector_table_compacted(spark, sf):
    t = store.VectorTable(spark, new_path(spark, "vectors"))
    t.save_all(long_heads(spark, sf).withColumn("vec", F.reverse("vec")))
    t.append(long_heads(spark, sf), 1)
    small = t.compact(new_path(spark, "vectors"))
    return marks(small.all()).groupBy("head").agg(F.count("*").alias("n"), F.round(F.sum("mark"), 3).alias("total"))


@query(f"{knn_sql(COS2)}\n{OUT}")
def knn_ivf_appended(spark, sf):
    """Half of the vectors appended to a written index, then all cells searched."""
    docs, path = plain(spark, sf, "doc_num"), new_path(spark, "ivf")
    cells = ivf.fit(docs)
    ivf.write(docs.where("doc_num % 2 = 0"), cells, path)
    ivf.append(docs.where("doc_num % 2 = 1"), cells, path)
    return shown(ivf.search(ivf.read(spark, path), cells, plain(spark, sf, "qid"), 10, probes=len(cells.centroids)))


@query(f"SELECT vec_id AS doc_num, {MARK.format('embedding')} AS mark FROM embeddings")
def fvecs_round_trip(spark, sf):
    """Vectors written as a benchmark file and read back in ranges."""
    path = new_path(spark, "fvecs")
    fvecs.write_fvecs(plain(spark, sf, "doc_num"), path)
    return marks(fvecs.read_fvecs(spark, path, 64))


@query("""WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT *, ('0x' || substr(md5('5:' || i), 1, 10))::BIGINT / 1099511627776.0::DOUBLE AS u FROM e),
s AS (SELECT a.i AS qid, b.i AS doc_num, round(-list_distance(a.v, b.v), 9) AS d FROM u a, u b WHERE a.u < 0.1 AND b.u >= 0.1)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d DESC, doc_num) AS rank, doc_num, round(-d * d, 6) + 0.0 AS score FROM s QUALIFY rank <= 100""")
def fvecs_dataset(spark, sf):
    """A vector file cut into base and queries, with the exact nearest by squared distance."""
    path = new_path(spark, "fvecs")
    fvecs.write_fvecs(plain(spark, sf, "doc_num"), path)
    return fvecs.dataset(spark, path, 64)[2].withColumn("score", F.round("score", 6) + 0.0)


@query("SELECT true AS verified, true AS damage_found, count(*) AS rows FROM events")
def sst_checksum(spark, sf):
    """A sorted table with its checksum: opened, and refused after a row more; one without a checksum is read as it is."""
    path = new_path(spark, "sst")
    rows = event_log(spark, sf)
    store.write_table(rows, path)
    n = store.open_table(spark, path).count()
    rows.limit(1).write.mode("append").parquet(path)
    try:
        store.open_table(spark, path)
        found = False
    except ValueError:
        found = True
    old = new_path(spark, "sst")
    store.write_sorted(rows, old)
    return spark.createDataFrame([(store.open_table(spark, old).count() == n, found, n)], "verified boolean, damage_found boolean, rows bigint")


@query("SELECT user_id::VARCHAR AS key, max(event_id) AS seq FROM events WHERE user_id IN (3, 4) GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def store_get(spark, sf):
    """Point reads of a log: the latest, if it lives."""
    log = event_log(spark, sf)
    return store.get(log, "3").unionByName(store.get(log, "4")).select("key", "seq")


@query("SELECT false AS early, true AS late, count(*) AS rows FROM events")
def store_flush(spark, sf):
    """A memory table goes to files once it is large enough."""
    log, path = event_log(spark, sf), new_path(spark, "flush")
    early, late = store.flush(log, path, 10**9), store.flush(log, path, 500)
    return spark.createDataFrame([(early, late, spark.read.parquet(path).count())], "early boolean, late boolean, rows bigint")


@query("SELECT k AS key, v AS value, 5::BIGINT AS ts, false AS deleted FROM (VALUES ('alpha', 'one'), ('beta', 'two')) t(k, v)")
def store_entries(spark, sf):
    return store.entries_from_map(spark, {"beta": "two", "alpha": "one"}, 5)


@query("SELECT vec_id AS doc_num FROM embeddings WHERE label = 3")
def tag_filter(spark, sf):
    """Records tagged by class; those of one."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_num"), F.array(F.lit("x"), F.concat(F.lit("collection:c"), F.col("label").cast("string"))).alias("tags"))
    return store.tagged(e, "c3").select("doc_num")


@query("SELECT 0::BIGINT AS shard, 'semantic temporal' AS heads UNION ALL SELECT 2, 'semantic'")
def shard_assignment(spark, sf):
    s = spark.createDataFrame([(i, ["semantic"] if i != 1 else ["temporal"]) for i in range(3)], "shard bigint, heads array<string>")
    s = shard.unassign(shard.assign(s, 0, "temporal"), 1)
    return s.join(shard.shards_of_head(s, "semantic"), "shard").select("shard", F.array_join(F.array_sort("heads"), " ").alias("heads"))


# ---- translation and fusion


@query(f"SELECT vec_id AS doc_num, {MARK.format('embedding')} AS mark FROM embeddings")
def translate_single(spark, sf):
    return marks(translate.single(wide(spark, sf), "doc_num"))


@query(f"{V_SQL} SELECT doc_num, {MARK.format('list_concat(CASE WHEN doc_num % 5 > 0 THEN semantic ELSE [] END, CASE WHEN doc_num % 3 > 0 THEN temporal ELSE [] END, structural)')} AS mark FROM v")
def translate_concatenated(spark, sf):
    """Documents that lack heads are the others' vectors in a row."""
    return marks(translate.concatenated(gappy(wide(spark, sf), "doc_num"), "doc_num"))


@query(f"{V_SQL} SELECT doc_num AS qid, head, {MARK.format('vec')} AS mark FROM hv WHERE head <> 'structural' AND (head = 'semantic' OR doc_num % 3 > 0)")
def translate_per_head(spark, sf):
    """The heads that a query enables and has."""
    q = wide(spark, sf, "qid").withColumn("temporal", F.when(F.col("qid") % 3 > 0, F.col("temporal"))).withColumn("enabled", F.array(F.lit("semantic"), F.lit("temporal")))
    return marks(translate.per_head(q, "qid"))


@query("SELECT strategy, multi, NOT (strategy = 'per_head_rrf' AND NOT multi) AS allowed FROM (VALUES ('semantic_only'), ('concatenation'), ('per_head_rrf')) t(strategy), (VALUES (false), (true)) u(multi)")
def translate_allowed(spark, sf):
    out = []
    for s in translate.STRATEGIES:
        for multi in (False, True):
            try:
                translate.validate(s, translate.Capabilities(multi))
                out.append((s, multi, True))
            except ValueError:
                out.append((s, multi, False))
    return spark.createDataFrame(out, "strategy string, multi boolean, allowed boolean")


SINGLE = "head = 'semantic'"


@query("SELECT true AS same")
def single_head_ranking(spark, sf):
    """A single head, fused or not, gives one ranking."""
    a = fusion.attend(wide(spark, sf), asking(spark, sf), ["semantic"], 10)
    return search.same_ranking(a, search.knn(plain(spark, sf, "doc_num"), plain(spark, sf, "qid"), 10))


DEMO = "CASE head WHEN 'temporal' THEN 0.7 WHEN 'semantic' THEN 1 ELSE 0.5 END"


@query(f"""{lists_sql(20)}, f AS (SELECT qid, doc_num, sum(score * {DEMO}) AS s FROM l GROUP BY ALL), g AS (SELECT qid, doc_num, round(CASE WHEN max(s) OVER (PARTITION BY qid) > 0 THEN s / max(s) OVER (PARTITION BY qid) ELSE s END, 9) AS score FROM f)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_num) AS rank, doc_num, score FROM g QUALIFY rank <= 5""")
def fuse_by_best(spark, sf):
    """Weighted sums over the best of them."""
    weights = {"semantic": 1.0, "temporal": 0.7, "structural": 0.5}
    return fusion.fuse_by_best(search.lists_to_fuse(wide(spark, sf), asking(spark, sf), weights, 20, 5, normal=False), weights, 5)


def failing_sql(temporal: str, queries: bool = False) -> str:
    if queries:
        return attend_sql("1.0 / 3").replace("list_cosine_similarity(qv, vec)", f"list_cosine_similarity(CASE WHEN head = 'temporal' THEN {temporal} ELSE qv END, vec)")
    return attend_sql("1.0 / 3").replace("list_reverse(embedding)::DOUBLE[]", temporal)


def noise_sql(vec: str, key: str, amount: float) -> str:
    n = "('0x' || substr(md5('3:' || {k} || ':' || (i - 1)), 11, 10))::BIGINT / 1099511627776.0::DOUBLE".format(k=key)
    return f"list_transform({vec}, lambda x, i: x + ({n} * 2 - 1) * {amount})"


def experiment(spark, sf, name: str) -> DataFrame:
    heads, failure = workload.EXPERIMENTS[name]
    docs, asked = workload.failed_documents(wide(spark, sf), failure), workload.failed_queries(asking(spark, sf), failure)
    return shown(fusion.attend(docs, asked, heads))


CORRUPT = "CASE WHEN ('0x' || substr(md5('42:f:' || vec_id), 1, 10))::BIGINT / 1099511627776.0::DOUBLE < 0.25 THEN " + noise_sql("list_reverse(embedding)::DOUBLE[]", "vec_id", 0.5) + " ELSE list_reverse(embedding)::DOUBLE[] END"


@query(failing_sql(CORRUPT))
def failure_corruption(spark, sf):
    """A quarter of the documents with noise in the temporal head."""
    return experiment(spark, sf, "corruption_25")


@query(attend_sql("1.0 / 3", "head <> 'temporal'"))
def failure_missing_head(spark, sf):
    return experiment(spark, sf, "missing_head")


@query(failing_sql("list_transform(list_reverse(embedding)::DOUBLE[], lambda x: -x)"))
def failure_conflicting_head(spark, sf):
    return experiment(spark, sf, "conflicting_head")


@query(failing_sql(noise_sql("qv", "qid", 0.3), True))
def failure_adversarial_query(spark, sf):
    return experiment(spark, sf, "adversarial_query")


@query("SELECT name, heads FROM (VALUES " + ", ".join(f"('{n}', {len(h)})" for n, (h, _) in workload.EXPERIMENTS.items()) + ") t(name, heads)")
def experiments(spark, sf):
    return spark.createDataFrame([(n, len(h)) for n, (h, _) in workload.EXPERIMENTS.items()], "name string, heads int")


@query("SELECT level, noise, clusters FROM (VALUES ('easy', 0.05::DOUBLE, 10), ('medium', 0.1, 20), ('hard', 0.15, 50), ('very_hard', 0.2, 100), ('super_hard', 0.25, 200), ('extremely_hard', 0.3, 400)) t(level, noise, clusters)")
def difficulty_levels(spark, sf):
    import math

    return spark.createDataFrame([(n, d.noise, math.ceil(1000 * d.density)) for n, d in workload.LEVELS.items()], "level string, noise double, clusters int")


def unit_sql(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 10))::BIGINT / 1099511627776.0::DOUBLE"


@query(f"""WITH c AS (SELECT i, list_transform(range(16), lambda j: {unit_sql("'42:c:semantic:' || (i % 20) || ':' || j")} - 0.5) AS v FROM range(400) t(i)),
u AS (SELECT i, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM c), d AS (SELECT i, list_transform(v, lambda x, j: x + {unit_sql("'42:d:semantic:' || i || ':' || (j - 1)")} * 0.15) AS v FROM u)
SELECT i AS doc_num, round(list_sum(list_transform(v, lambda x, j: x / sqrt(list_dot_product(v, v)) * j)), 5) AS mark FROM d""")
def generated_corpus(spark, sf):
    """A clustered corpus of the hard level, as its digests give it."""
    return marks(workload.clustered(spark, 400, ["semantic"], 16, "hard").withColumnRenamed("semantic", "vec"))


@query(f"""WITH d AS (SELECT i, list_transform(range(16), lambda j: {unit_sql("'42:doc_num:' || i || ':' || j")} - 0.5) AS v FROM range(300) t(i)), u AS (SELECT i, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM d),
q AS (SELECT k AS qid, v AS qv FROM range(450) t(k) JOIN u ON u.i = k % 300), s AS (SELECT qid, i AS doc_num, round(greatest(-1, least(1, list_cosine_similarity(qv, v))), 9) AS score FROM q, u)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_num) AS rank, doc_num, round(score, 9) AS score FROM s QUALIFY rank <= 5""")
def generated_queries(spark, sf):
    """Uniform vectors; query i is document i modulo their number, and its nearest is that."""
    docs = workload.synthetic(spark, 300, 16)
    return shown(search.knn(docs, workload.queries_of(docs, 450), 5, vec="semantic"))


@query("""WITH d AS (SELECT i, list_transform(range(32), lambda j: sin(i * 0.1::DOUBLE + j * 0.3::DOUBLE) * (i % 7 + 1) * 0.15 + CASE WHEN j % 10 = i % 10 THEN 0.5 ELSE 0 END) AS v FROM range(350) t(i))
SELECT i AS doc_num, round(list_sum(list_transform(v, lambda x, j: x / sqrt(list_dot_product(v, v)) * j)), 5) AS mark FROM d""")
def generated_waves(spark, sf):
    return marks(workload.waves(spark, 350, 32))


@query("SELECT n, kind, builds, runs FROM (VALUES (100000::BIGINT, 'full', 30, 30), (1000000, 'split', 5, 30), (1000001, 'query_only', 1, 30)) t(n, kind, builds, runs)")
def run_protocols(spark, sf):
    found = [(n, workload.protocol(n)) for n in (100_000, 1_000_000, 1_000_001)]
    return spark.createDataFrame([(n, p["kind"], p["builds"], p["query_runs"]) for n, p in found], "n bigint, kind string, builds int, runs int")


# ---- measures


QUALITY = f"""{lists_sql(50)},
g AS (SELECT a.vec_id AS qid, b.vec_id AS doc_num FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id <> b.vec_id),
i AS (SELECT qid, sum(CASE WHEN i <= 10 THEN 1 / log2(i + 1) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY doc_num) AS i FROM g) GROUP BY qid)"""


def ndcg_sql(name: str, source: str) -> str:
    return f"""{name} AS (SELECT i.qid, round(least(1, coalesce(sum(CASE WHEN g.qid IS NOT NULL THEN 1 / log2(rank + 1) END), 0) / any_value(idcg)), 9) AS ndcg FROM i LEFT JOIN {source} r ON r.qid = i.qid LEFT JOIN g ON g.qid = r.qid AND g.doc_num = r.doc_num GROUP BY i.qid)"""


@query(f"""{QUALITY}, {fused_sql('CASE head WHEN ' + "'semantic' THEN 0.8 ELSE 0.1 END", 10).replace('f AS', 'f1 AS').replace('r AS', 'r1 AS').replace('FROM f QUALIFY', 'FROM f1 QUALIFY')}, {fused_sql('1.0 / 3', 10)},
{ndcg_sql('a', 'r1')}, {ndcg_sql('b', 'r')} SELECT qid, round(CASE WHEN b.ndcg < 1e-15 THEN 0 ELSE (a.ndcg - b.ndcg) / b.ndcg END, 6) AS efficiency FROM a JOIN b USING (qid)""")
def gating_efficiency(spark, sf):
    """What weights gain over uniform ones in nDCG."""
    lists = fusion.max_normalised(search.head_lists(wide(spark, sf), asking(spark, sf), HEADS, fusion.fetch_count(10)))
    gained, plain_ = fusion.fuse_both(lists, search.weight_of(F.col("head"), {"semantic": 0.8, "temporal": 0.1, "structural": 0.1}), F.lit(1.0 / len(HEADS)), 10)
    quality = lambda found: label_quality(spark, sf, found, 10, False)
    return metrics.gating_efficiency(quality(gained), quality(plain_)).withColumn("efficiency", F.round("efficiency", 6))


CURVES = "WITH p AS (SELECT label, vec_id, rank() OVER (PARTITION BY label ORDER BY vec_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings), c AS (SELECT label, i::DOUBLE / n AS recall, 10000.0::DOUBLE * (label + 1) / i AS qps FROM p)"


@query(f"""{CURVES}, w AS (SELECT *, lead(recall) OVER (PARTITION BY label ORDER BY recall, qps) AS r2, lead(qps) OVER (PARTITION BY label ORDER BY recall, qps) AS q2 FROM c),
t AS (SELECT label, t, round(max(CASE WHEN recall <= t AND r2 >= t AND r2 > recall THEN qps + (q2 - qps) * (t - recall) / (r2 - recall) END), 6) AS q FROM w, (VALUES (0.9::DOUBLE), (0.95), (0.99)) v(t) GROUP BY ALL)
SELECT x.label AS a, y.label AS b, bool_and(coalesce(x.q >= y.q, x.q IS NOT NULL AND y.q IS NULL)) AS dominates FROM t x JOIN t y USING (t) WHERE x.label <> y.label GROUP BY ALL""")
def pareto_dominance(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("label")
    e = table(spark, sf, "embeddings").select("label", F.row_number().over(w.orderBy("vec_id")).alias("i"), F.count("*").over(w).alias("n"))
    return metrics.dominance(e.select("label", (F.col("i") / F.col("n")).alias("recall"), (F.lit(10000.0) * (F.col("label") + 1) / F.col("i")).alias("qps")), "label")


@query("""WITH m AS (SELECT event_type, count(value) AS n, avg(value) AS x, var_samp(value) AS v FROM events GROUP BY event_type)
SELECT b.event_type AS b, round((a.x - b.x) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 3) AS df, true AS corrected FROM m a, m b WHERE a.event_type = 'view' AND b.event_type <> 'view'""")
def compare_to_all(spark, sf):
    """Views against every other kind of event; q is p or more, and agrees with what is rejected."""
    c = metrics.compare_to_all(table(spark, sf, "events"), "value", "event_type", "view")
    return c.select("b", "t", "df", ((F.col("q") >= F.col("p") - 1e-9) & (F.col("rejected") == (F.col("q") <= 0.05))).alias("corrected"))


@query("SELECT measure, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, true AS inside FROM (SELECT 'value' AS measure, value AS x FROM events UNION ALL SELECT 'user', user_id::DOUBLE FROM events) GROUP BY measure")
def aggregated_measures(spark, sf):
    """Mean, deviation, and whether both intervals hold the mean."""
    e = table(spark, sf, "events").select("value", F.col("user_id").cast("double").alias("user"))
    a = metrics.aggregate_quality(e, ["value", "user"], rounds=200)
    return a.select("measure", "n", "mean", "std", (F.col("mean").between(F.col("low"), F.col("high")) & F.col("mean").between(F.col("boot_low"), F.col("boot_high"))).alias("inside"))


@query(f"""{knn_sql('-list_distance(x, y)', 11)}, o AS (SELECT qid, -score AS d FROM r WHERE qid <> doc_num QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 10),
n AS (SELECT qid, d, max(d) OVER (PARTITION BY qid) AS far FROM o), g AS (SELECT qid, count(*) AS k, sum(CASE WHEN d > 0 THEN ln(d / far) ELSE 0 END) AS s FROM n GROUP BY qid),
li AS (SELECT round(CASE WHEN s < 0 THEN -(k - 1) / s ELSE k END, 6) AS lid FROM g),
c AS (SELECT coalesce(n, 0)::DOUBLE AS c FROM embeddings LEFT JOIN (SELECT doc_num, count(*) AS n FROM r WHERE rank <= 10 GROUP BY doc_num) ON vec_id = doc_num), m AS (SELECT avg(c) AS m, stddev_samp(c) AS sd FROM c),
b AS (SELECT a.vec_id AS qid, b.vec_id AS doc_num, round(greatest(-1, least(1, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 5 = 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_num) <= 2),
gp AS (SELECT qid, max(score) - min(score) AS gap, arg_max(doc_num, (score, -doc_num)) AS top FROM b GROUP BY qid),
rg AS (SELECT vec_id, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS i FROM embeddings), rq AS (SELECT vec_id AS qid, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) AS i FROM embeddings WHERE vec_id % 5 = 0),
near AS (SELECT avg(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS d FROM gp JOIN embeddings a ON a.vec_id = qid JOIN embeddings b ON b.vec_id = top),
rnd AS (SELECT avg(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS d FROM rq JOIN rg ON rg.i = rq.i % (SELECT count(*) FROM embeddings) JOIN embeddings a ON a.vec_id = qid JOIN embeddings b ON b.vec_id = rg.vec_id)
SELECT round(near.d / rnd.d, 6) AS contrast_ratio, (SELECT round(avg(lid), 6) FROM li) AS mean_lid, (SELECT round(stddev_pop(lid), 6) FROM li) AS std_lid, (SELECT round(avg(((c - m) / sd) ** 3), 6) FROM c, m) AS hubness_skewness, (SELECT round(avg((gap > 0.05)::INT), 6) FROM gp) AS unambiguous_top1 FROM near, rnd""")
def measured_difficulty(spark, sf):
    """All vectors, asked by every fifth of them."""
    return metrics.measured_difficulty(plain(spark, sf, "qid").where("qid % 5 = 0"), plain(spark, sf, "doc_num"))


@query("SELECT system, recall_10, latency_mean_ms FROM (SELECT event_type AS system, printf('%.4f', avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END)) AS recall_10, printf('%.2f', round(avg(value), 6)) AS latency_mean_ms FROM events GROUP BY event_type)")
def report_csv(spark, sf):
    """A table of results written as CSV, JSON and text, and read back."""
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("system")).agg(F.avg((F.col("value") > 50).cast("double")).alias("recall_10"), F.round(F.avg("value"), 6).alias("latency_mean_ms"))
    folder = new_path(spark, "report")
    sinks.write_report(e, folder, {"system": None, "recall_10": 4, "latency_mean_ms": 2})
    return spark.read.option("header", True).csv(f"{folder}/csv")


@query(f"{CURVES} SELECT 'all' AS dataset, label::VARCHAR AS algorithm, count(*) AS points, round(max(recall), 6) AS best FROM c GROUP BY label")
def report_curves(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("label")
    e = table(spark, sf, "embeddings").select(F.lit("all").alias("dataset"), F.col("label").cast("string").alias("system"), (F.row_number().over(w.orderBy("vec_id")) / F.count("*").over(w)).alias("recall"), F.lit(1.0).alias("qps"))
    path = new_path(spark, "curves")
    sinks.write_curves(e, path)
    back = spark.read.schema("dataset string, algorithm string, curve array<struct<recall:double,qps:double>>").json(path)
    return back.select("dataset", "algorithm", F.size("curve").cast("bigint").alias("points"), F.round(F.array_max("curve.recall"), 6).alias("best"))


@query("SELECT word, stem FROM (VALUES ('caresses', 'caress'), ('ponies', 'poni'), ('cats', 'cat'), ('agreed', 'agreed'), ('plastered', 'plastere'), ('motoring', 'motore'), ('sing', 'sing'), ('hopping', 'hop'), ('sky', 'sky'), ('an', 'an')) t(word, stem)")
def stems(spark, sf):
    return spark.createDataFrame([(w, stem(w)) for w in ("caresses", "ponies", "cats", "agreed", "plastered", "motoring", "sing", "hopping", "sky", "an")], "word string, stem string")


@query("SELECT effect, CASE effect WHEN 0.5 THEN 63 WHEN 0.2 THEN 393 ELSE 16 END AS n FROM (VALUES (0.5::DOUBLE), (0.2), (1.0)) t(effect)")
def sample_sizes(spark, sf):
    return spark.createDataFrame([(e, metrics.sample_size(e)) for e in (0.5, 0.2, 1.0)], "effect double, n int")


@query("SELECT i, true AS falls FROM range(3) t(i)")
def contrastive_training(spark, sf):
    """The loss of each of three steps over pairs of a class is below that of the step before."""
    import numpy as np

    e = table(spark, sf, "embeddings").select(F.col("embedding").alias("q"), F.reverse("embedding").alias("pos"))
    p, negatives = learn.Projection.init(64, 1), np.random.RandomState(2).randn(8, 64)
    loss = [learn.train_step(e, negatives, p, 0.05) for _ in range(4)]
    return spark.createDataFrame([(i, bool(loss[i + 1] < loss[i])) for i in range(3)], "i bigint, falls boolean")


@query("SELECT true AS learned, true AS loaded, true AS refused")
def gating_training(spark, sf):
    """The network comes nearer to its targets, and its flat weights make the same network again."""
    import numpy as np

    g = learn.Gating(2, 8, 1)
    examples = [(np.full(8, x), np.array([y, 1 - y])) for x, y in ((0.5, 0.7), (0.1, 0.2), (0.9, 0.9))]
    off = lambda n: sum(abs(n.forward(q) - t).sum() for q, t in examples)
    before = off(g)
    g.train(examples, 200)
    other = learn.Gating(2, 8, 5)
    refused = not other.load([1.0])
    return spark.createDataFrame([(bool(off(g) < before), bool(other.load(g.flat()) and abs(off(other) - off(g)) < 1e-12), refused)], "learned boolean, loaded boolean, refused boolean")
