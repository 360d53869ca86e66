import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mhr.functions import vectors as V
from mhr.functions.text import stem
from mhr.operators import fusion, ivf, learn, metrics, search, shard
from mhr.plans import lang
from mhr.plans.session import Engine
from mhr.sources import fvecs, store


def lists(spark, rows):
    return spark.createDataFrame(rows, "qid bigint, head string, doc_num bigint, score double, rank bigint")


def test_fusion_numbers(spark):
    two = lists(spark, [(0, "semantic", 1, 0.9, 1), (0, "semantic", 2, 0.8, 2), (0, "temporal", 2, 0.85, 1), (0, "temporal", 3, 0.7, 2)])
    got = {r.doc_num: r.score for r in fusion.weighted_fuse(two, {"semantic": 0.6, "temporal": 0.4}).collect()}
    assert got[2] == pytest.approx(0.82)
    assert fusion.weighted_fuse(two, {"semantic": 1.0, "temporal": 0.0}, 1).first().doc_num == 1
    one = lists(spark, [(0, "a", 1, 0.5, 2), (0, "a", 2, 1.0, 1), (0, "a", 3, 0.25, 3)])
    assert {r.doc_num: r.score for r in fusion.max_normalised(one).collect()} == {1: 0.5, 2: 1.0, 3: 0.25}
    hits = spark.createDataFrame([(1, 0, 101, 0.95), (1, 0, 102, 0.8), (2, 0, 201, 0.9), (2, 0, 202, 0.85)], "shard int, qid bigint, doc_num bigint, score double")
    assert [r.doc_num for r in shard.scatter_gather(hits, 4).orderBy("rank").collect()] == [101, 201, 202, 102]


def test_knn_equals_numpy_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 64)  # many blocks
    r = np.random.RandomState(0)
    x = np.round(r.randn(300, 8), 1)
    x[200:] = x[:100]
    x[7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 8), (999, None)]
    docs, qs = spark.createDataFrame(rows, "doc_num bigint, vec array<double>"), spark.createDataFrame(rows, "qid bigint, vec array<double>")
    n = np.linalg.norm(x, axis=1)
    want = {"dot_product": x @ x.T, "l2": -np.linalg.norm(x[:, None] - x[None], axis=2), "cosine": (x @ x.T) / np.maximum(np.outer(n, n), 1e-12)}
    for metric, s in want.items():
        s = np.round(s, 9) + 0.0
        got = search.knn(docs, qs, 10, metric).collect()
        assert len(got) == 3000
        for row in got:
            order = np.lexsort((np.arange(300), -s[row.qid]))
            assert order[row.rank - 1] == row.doc_num and row.score == pytest.approx(s[row.qid, row.doc_num], abs=2e-9)
    assert search.knn(docs.limit(0), qs, 3).count() == 0
    with pytest.raises(Exception, match="dimension"):
        search.knn(docs, spark.createDataFrame([(1, [1.0])], "qid bigint, vec array<double>"), 3).count()


def test_lists_and_ground_truth_without_heads(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0], None), (2, None, [0.0, 1.0]), (3, None, None), (4, [1.0, 1.0], [1.0, 0.0])], "doc_num bigint, a array<double>, b array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0], [0.0, 1.0])], "qid bigint, a array<double>, b array<double>")
    got = {(r["head"], r.doc_num): r.score for r in search.head_lists(docs, q, ["a", "b"], 5).collect()}
    assert got == {("a", 1): 1.0, ("a", 4): pytest.approx(0.5**0.5), ("b", 2): 1.0, ("b", 4): 0.0}
    truth = {r.doc_num: r.score for r in search.ground_truth(docs, q, ["a", "b"]).collect()}
    assert truth == {1: 0.5, 2: 0.5, 4: pytest.approx(0.5**1.5), 3: 0.0}


def test_ivf_index(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    docs, qs = (e.select(F.col("vec_id").alias(k), F.col("embedding").alias("vec")) for k in ("doc_num", "qid"))
    cells = ivf.fit(docs)
    exact = search.knn(docs, qs, 10)
    pairs = lambda df: {(r.qid, r.rank, r.doc_num) for r in df.collect()}
    for ef in (32, 64, 128):
        near = ivf.search(ivf.index(docs, cells), cells, qs, 10, ef)
        assert near.join(exact, ["qid", "doc_num"]).count() >= ivf.recall_for(ef) * exact.count()
    ivf.write(docs.where("doc_num < 300"), cells, str(tmp_path / "i"))
    ivf.append(docs.where("doc_num >= 300"), cells, str(tmp_path / "i"))
    whole = ivf.search(ivf.read(spark, str(tmp_path / "i")), cells, qs, 10, probes=10**6)
    assert pairs(whole) == pairs(exact) and ivf.cells_for(10**9) == ivf.MOST
    none = ivf.fit(docs.limit(0))
    assert ivf.search(ivf.index(docs.limit(0), none), none, qs, 3).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        ivf.search(ivf.index(docs, cells), cells, spark.createDataFrame([(1, [1.0])], "qid bigint, vec array<double>"), 3).count()


def test_vector_text_and_projection(spark):
    rows = [("[1, 2.5,]", [1.0, 2.5]), ("3,x", None), ("", None), ("[]", None), (None, None), (" 11,1 ", [11.0, 1.0])]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r.v for r in df.select(V.parse_vector(F.col("t")).alias("v")).collect()] == [v for _, v in rows]
    one = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "a array<double>, b array<double>")
    r = one.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.normalised(F.col("b")).alias("u"), V.normalised(F.col("a")).alias("z"), V.softmax(F.col("b")).alias("s")).first()
    assert r.c == 0 and r.u == [0.6, 0.8] and r.z == [0.0, 0.0] and sum(r.s) == pytest.approx(1)


def test_stemmer():
    for word, want in {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agreed", "plastered": "plastere", "motoring": "motore", "sing": "sing", "hopping": "hop", "sky": "sky", "an": "an"}.items():
        assert stem(word) == want, word


def test_language():
    s = lang.parse('ATTEND TO docs WHERE QUERY "big data" HEADS [semantic, temporal] TOP_K 5 MIN_WEIGHT 0.2 TEMPORAL_DECAY 0.5;')
    assert s == lang.Attend("docs", "big data", ("semantic", "temporal"), 5, 0.2, 0.5)
    assert [lang.plan(lang.Attend("d", "q", top_k=k)).ef for k in (5, 20, 21)] == [32, 64, 128]
    p = lang.plan(s)
    assert p.weights == {"semantic": 1.0, "temporal": 0.5} and p.candidates == 15
    assert lang.parse('ATTEND TO d WHERE QUERY "q" TOP_K 5.5').top_k == 10
    c = lang.parse('CREATE COLLECTION c (title TEXT) WITH (ef_search = 100, semantic.similarity = "l2", exact_rerank = false)')
    assert c.settings.ef_search == 100 and c.per_head["semantic"].similarity == "l2" and not c.settings.exact_rerank
    assert lang.parse("CREATE COLLECTION c ()").fields == ()
    for bad in ("GARBAGE INPUT", "ATTEND TO x", "ALTER COLLECTION c SET (colour = 1)", 'ALTER COLLECTION c SET (similarity = "x")', "attend to x"):
        with pytest.raises(lang.StatementError):
            lang.parse(bad)


def test_engine_round_trip(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.run_statement("CREATE COLLECTION docs (title TEXT) WITH (ef_search = 80)")
    unit = lambda i: [float(j == i) for j in range(64)]
    e.insert("docs", {i: {"title": f"paper {i} about winters", "semantic_vector": str(unit(i))} for i in range(6)})
    e.insert("docs", {3: {"title": "newer", "semantic_vector": str(unit(40))}})
    e.delete("docs", 2)
    with pytest.raises(ValueError):
        e.insert("docs", {9: {"title": "no vector"}})
    again = Engine(spark, str(tmp_path / "db"))  # a restart
    top = again.run_statement('ATTEND TO docs WHERE QUERY "q" TOP_K 2', unit(1)).collect()
    assert top[0].doc_num == 1 and top[0].fields["title"].startswith("paper 1") and len(top) == 2 and top[0].has_more
    assert {r.doc_num for r in again.documents("docs").collect()} == {0, 1, 3, 4, 5}
    assert again.search("docs", unit(40), top_k=1, text="newer").first().doc_num == 3
    assert again.stats() == [("docs", 1, 5)] and again.list_heads("docs") == ["semantic"]
    made = again.backup("docs", str(tmp_path / "b"), "one")
    assert again.compact("docs") == 5 and made["tables"]["docs"]["rows"] == 8
    again.restore("docs", str(tmp_path / "b"), "one")
    assert again.documents("docs").count() == 5
    again.run_statement('ALTER COLLECTION docs SET (similarity = "l2")')
    assert again.run_statement("SHOW COLLECTION docs SETTINGS")["settings"]["ef_search"] == 64
    again.delete_collection("docs")
    assert again.list_collections() == []


def test_compaction_numbers(spark):
    files = [spark.createDataFrame([(f"k{f * 10 + i}", f"v{i}", 1, f * 10 + i in (5, 15)) for i in range(10)], "key string, value string, ts bigint, deleted boolean") for f in range(4)]
    kept, counts = store.compact(files)
    assert kept.count() == 38 and counts.first().tombstones_removed == 2


def test_transaction_and_replay(spark, tmp_path):
    t = store.Transaction(spark, str(tmp_path / "log"), 1)
    t.record("insert", "a", "1")
    t.rollback()
    t.record("insert", "a", "2")
    t.record("delete", "b")
    assert t.commit() == 2 and t.commit() == 0
    log = spark.read.parquet(str(tmp_path / "log"))
    assert [r.payload for r in store.latest(store.replay(log)).collect()] == ["2"]
    assert store.replay(log.withColumn("crc", F.when(F.col("seq") == 1, 0).otherwise(F.col("crc")))).count() == 0


def test_streaming_ingest_equals_batch(spark, tmp_path):
    from mhr.streaming import ingest

    log = store.log_rows(spark.range(50), F.col("id"), F.when(F.col("id") % 7 == 6, "delete").otherwise("insert"), F.col("id") % 10, F.lit(0), F.col("id").cast("string"))
    for k in range(2):
        log.where(F.col("seq") % 2 == k).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.append(ingest.log_stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    rows = lambda df: sorted((r.key, r.seq) for r in df.collect())
    assert rows(ingest.view(spark, str(tmp_path / "t"))) == rows(store.latest(log))


def test_fvecs(spark, tmp_path):
    x = np.random.RandomState(1).randn(200, 4).astype("<f4")
    body = np.concatenate([np.full((200, 1), 4, "<i4").view("<f4"), x], 1)
    (tmp_path / "v.fvecs").write_bytes(body.tobytes())
    got = fvecs.read_fvecs(spark, str(tmp_path / "v.fvecs"), 4).orderBy("doc_num").collect()
    assert np.allclose([r.vec for r in got], x)


def test_learning(spark):
    r = np.random.RandomState(2)
    pairs = spark.createDataFrame([(v.tolist(), (v + 0.1 * r.randn(6)).tolist()) for v in r.randn(60, 6)], "q array<double>, pos array<double>")
    p, negs = learn.Projection.init(6), r.randn(10, 6)
    assert learn.train_step(pairs, negs, p, 0.05) > learn.train_step(pairs, negs, p, 0.05)
    with pytest.raises(ValueError):
        learn.train_step(pairs, np.zeros((0, 6)), p)
    g = learn.Gating(2, 8)
    before = g.forward(np.full(8, 0.9))[0]
    g.train([(np.full(8, 0.5), np.array([0.7, 0.3])), (np.full(8, 0.1), np.array([0.2, 0.8])), (np.full(8, 0.9), np.array([0.9, 0.1]))], 100)
    assert g.forward(np.full(8, 0.9))[0] > before and not g.load([1.0]) and g.load(g.flat())


def test_ring_balance(spark):
    keys = spark.range(10_000).select(F.concat(F.lit("document_uuid_"), F.col("id")).alias("key"))
    got = dict(shard.route(keys, shard.ring(spark, [1, 2, 3], 200), "key").groupBy("shard").count().collect())
    assert len(got) == 3 and all(2000 < n < 5000 for n in got.values())


def test_statistics(spark):
    assert metrics.t_p_value(2.228, 10) == pytest.approx(0.05, abs=1e-3) and metrics.t_quantile(0.975, 10) == pytest.approx(2.228, abs=1e-3)
    assert metrics.sample_size(0.5) == 63
    x = spark.createDataFrame([(float(v),) for v in range(1, 101)], "v double")
    mean, low, high = metrics.confidence_interval(x, "v")
    boot = metrics.bootstrap_interval(x, "v", 300).first()
    assert mean == 50.5 and low < mean < high and math.isclose(boot.low, low, abs_tol=2) and math.isclose(boot.high, high, abs_tol=2)


def test_engine_heads_settings_and_filters(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.create_collection("c", 4)
    rows = [(i, {"title": f"t{i}", "a_vector": str([1.0, i / 10, 0.0, 0.0]), **({"b_vector": str([0.0, 1.0, i / 10, 0.0])} if i % 2 else {})}) for i in range(8)]
    e.insert_table("c", spark.createDataFrame(rows, "doc_num bigint, fields map<string,string>"))
    with pytest.raises(ValueError, match="dimension"):
        e.insert_table("c", spark.createDataFrame([(9, {"a_vector": "[1]"})], "doc_num bigint, fields map<string,string>"))
    with pytest.raises(ValueError, match="no id"):
        e.insert_table("c", spark.createDataFrame([(None, {"a_vector": "[1,2,3,4]"})], "doc_num bigint, fields map<string,string>"))
    assert e.documents("c").count() == 8
    found = {r.doc_num for r in e.search("c", [0.0, 1.0, 0.0, 0.0], where="doc_num % 4 = 1").collect()}
    assert found == {1, 5}
    near = e.search("c", [1.0, 0.2, 0.0, 0.0], ["a"], approximate=True, top_k=3)
    assert [r.doc_num for r in near.collect()] == [r.doc_num for r in e.search("c", [1.0, 0.2, 0.0, 0.0], ["a"], top_k=3).collect()]
    e.remove_head("c", "b")
    assert e.list_heads("c") == ["a"]
    with pytest.raises(ValueError, match="no heads"):
        e.search("c", [1.0] * 4, ["b"])
    e.add_head("c", "b", weight=0.5)
    e.insert_vector("c", "fresh", 3, [0.0, 0.0, 0.0, 1.0])
    assert e.list_heads("c") == ["a", "b", "fresh"]
    assert e.search("c", [0.0, 0.0, 0.0, 1.0], ["fresh"]).first().doc_num == 3
    assert e.is_persistent() and e.flush() is None and e.health()["ready"] and not Engine(spark, str(tmp_path / "none")).health()["ready"]


def test_engine_commits(spark, tmp_path):
    """Two writers share no number; an unfinished commit is neither read nor compacted over; a broken-off compaction loses nothing."""
    a, b = Engine(spark, str(tmp_path / "db")), Engine(spark, str(tmp_path / "db"))
    a.create_collection("c", 2)
    doc = lambda t: {"title": t, "x_vector": "[1, 2]"}
    a.insert("c", {1: doc("first")})
    b.insert("c", {1: doc("second"), 2: doc("other")})
    held = store.claim(spark, a._path("c", "claims"))  # a writer that has claimed a number and not written yet
    a.insert("c", {3: doc("third")})
    titles = lambda: {r.doc_num: r.fields["title"] for r in a.documents("c").collect()}
    assert titles() == {1: "second", 2: "other", 3: "third"} and held == 3
    assert a.compact("c") == 2 and titles() == {1: "second", 2: "other", 3: "third"}  # up to the number that isn't finished
    log = store.log_rows(spark.createDataFrame([("4", str({}).replace("'", '"'), 0)], "key string, payload string, n bigint"), F.col("n"), F.lit("insert"), F.col("key"), F.lit(0), F.lit('{"title": "late", "x_vector": "[1, 2]"}'))
    log.withColumn("commit", F.lit(held).cast("bigint")).write.parquet(a._path("c", f"docs/commit-{held:012}"))
    assert titles()[4] == "late" and a.compact("c") == 4 and len(titles()) == 4
    (tmp_path / "db" / "c" / "docs" / "base-000000000099").mkdir()  # a compaction that broke off
    assert len(titles()) == 4


def test_block_cache_and_table_checksum(spark, tmp_path):
    c = store.BlockCache(lambda k: k.encode() * 10, capacity=3)
    for k in "abcadbb":
        c.get(k)
    assert (c.hits, c.misses, c.evictions) == (2, 5, 2) and list(c.blocks) == ["a", "d", "b"] and c.used == 30
    small = store.BlockCache(lambda k: bytes(100), budget=250)
    for k in "abcd":
        small.get(k)
    assert small.evictions == 2 and small.used == 200


def test_quantiles_of_skewed_groups(spark, monkeypatch):
    monkeypatch.setattr(metrics, "ACCURACY", 200)  # the sketch narrows
    r = np.random.RandomState(4)
    x = np.concatenate([np.round(r.exponential(10, 9000), 3), np.full(6000, 2.0), r.randn(40)])
    rows = [(None if i % 3 == 0 else "b", float(v)) for i, v in enumerate(x)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for nearest in (False, True):
        got = {(row.g, row.q): row.x for row in metrics.quantiles(df, "v", [0.0, 0.31, 0.5, 0.999, 1.0], "g", nearest=nearest).collect()}
        for g, mine in ((None, x[::3]), ("b", np.delete(x, np.arange(0, len(x), 3)))):
            for q in (0.0, 0.31, 0.5, 0.999, 1.0):
                want = np.sort(mine)[int(np.floor(q * (len(mine) - 1) + 0.5))] if nearest else np.quantile(mine, q)
                assert got[g, q] == pytest.approx(want), (g, q)
        assert ("c", 0.5) not in got


def test_corrected_tests_and_resampling(spark):
    r = np.random.RandomState(6)
    rows = [(s, float(v)) for s, m in (("a", 0.0), ("b", 0.1), ("c", 2.0)) for v in r.randn(300) + m]
    df = spark.createDataFrame(rows, "s string, v double")
    got = {x.b: x for x in metrics.compare_to_all(df, "v", "s", "a").collect()}
    assert set(got) == {"b", "c"} and got["c"].rejected and got["c"].p < 1e-6 and got["b"].q >= got["b"].p
    p = np.sort(r.rand(500))
    tests = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "k bigint, p double")
    q = np.minimum.accumulate(np.minimum(1, p * 500 / np.arange(1, 501))[::-1])[::-1]
    assert np.allclose([x.q for x in metrics.benjamini_hochberg(tests, "p", "k").orderBy("k").collect()], q, atol=2e-9)
    d = metrics.bootstrap_difference(df.where("s = 'c'"), df.where("s = 'a'"), "v", 300).first()
    assert d.low < d.difference < d.high and 0.05 < d.std_error < 0.12
    one = spark.createDataFrame([(i, 0.4 * i, 0.2 * i) for i in range(3)], "qid bigint, g double, u double")
    eff = metrics.gating_efficiency(one.select("qid", F.col("g").alias("ndcg")), one.select("qid", F.col("u").alias("ndcg")))
    assert [x.efficiency for x in eff.orderBy("qid").collect()] == [0.0, 1.0, 1.0]


def test_numbers_without_gaps(spark):
    ids = spark.range(5000).select((F.col("id") % 4000).cast("string").alias("id"), (F.col("id") % 7).alias("seq"))
    first = store.with_numbers(ids)
    assert sorted(r.doc_num for r in first.collect()) == list(range(1, 4001))
    more = store.with_numbers(spark.createDataFrame([("new", 1), ("5", 9)], "id string, seq bigint"), first)
    assert {r.id: r.doc_num for r in more.where("id in ('new', '5')").collect()}["new"] == 4001 and more.count() == 4001


def test_workload_runs(spark, tmp_path):
    from mhr.operators import workload as w

    c = w.Checkpoint(spark, str(tmp_path / "runs"))
    assert c.done() == []
    c.save(w.Checkpoint.name("mhr", "sift", 2000, "easy"))
    c.save("two")
    c.save("two")
    assert w.Checkpoint(spark, str(tmp_path / "runs")).done() == ["mhr/sift/2000@easy", "two"]
    c.clear()
    assert c.done() == []
    calls = []
    report = w.warm_up(lambda: calls.append(1), 60, 1e9)
    assert report["runs"] == len(calls) == 16
    w.verify_count(spark.range(3), 3)
    with pytest.raises(ValueError):
        w.verify_count(spark.range(3), 0)
    (tmp_path / "c.toml").write_text("dimension = 64\nef = [10]\n")
    assert w.config(str(tmp_path / "c.toml"), queries=500)["dimension"] == 64
    for bad in ({"dimension": 8}, {"experiments": ["x"]}, {"colour": 1}):
        with pytest.raises(ValueError):
            w.config(**bad)


def test_words_of_arrow_batches_equal_expressions(spark):
    """The vectorised words, with places and hashes, are those of the JVM's expressions."""
    import pyarrow as pa

    from mhr.functions.text import code_of, cut_words, words_with_positions

    texts = ["", "  One, two -- THREE!  ", "\u00c9t\u00e9 \u201cquoted\u201d \u2014 na\u00efve\u2026", "a\tb\nc", None, "--a--b-- ... x", "\u00bfQu\u00e9? 42%", "x " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    want = sorted((r.id, r.pos, r.term) for r in words_with_positions(df, F.col("text"), "id").collect())
    got = []
    for lo, _, buf, starts, ends, row, place in cut_words(pa.array(texts)):
        got += [(lo + int(r), int(p), buf[s:e].tobytes().decode()) for r, p, s, e in zip(row, place, starts, ends)]
    assert sorted(got) == want
    from mhr.functions.text import word_codes

    data = np.frombuffer("zwei drei".encode(), np.uint8)
    assert word_codes(data, np.array([0, 5]), np.array([4, 9])).tolist() == [code_of("zwei"), code_of("drei")]


def test_reports(spark, tmp_path):
    from mhr.sources import sinks

    rows = [{"system": "a_b", "x": 0.5}, {"system": "c", "x": None}]
    text = sinks.latex(rows, {"system": "System", "x": "R"}, "Caption", "tab:x")
    assert r"a\_b & 0.500 \\" in text and "c & $-$" in text and sinks.plain(rows, ["system", "x"]).splitlines()[1] == "a_b     0.500"


def test_translation_errors(spark):
    from mhr.operators import translate

    df = spark.createDataFrame([(1, None, None, None)], "id bigint, semantic array<double>, temporal array<double>, structural array<double>")
    for run in (lambda: translate.single(df, "id").collect(), lambda: translate.concatenated(df, "id").collect()):
        with pytest.raises(Exception, match="no "):
            run()
    assert translate.per_head(df.withColumn("enabled", F.array(F.lit("semantic"))), "id").count() == 0
    with pytest.raises(ValueError):
        translate.validate("other", translate.Capabilities())


def test_contrastive_gradients():
    """Against differences of the loss."""
    r = np.random.RandomState(3)
    p, q, pos, negs = learn.Projection.init(4, 1), r.randn(5, 4), r.randn(5, 4), r.randn(3, 4)
    _, gq, gk = learn.info_nce_gradients(p, q, pos, negs, 0.5)
    for name, g in (("q", gq), ("k", gk)):
        for i, j in ((0, 1), (2, 3), (3, 0)):
            w, loss = getattr(p, name), []
            for step in (1e-5, -2e-5):
                w[i, j] += step
                loss.append(learn.info_nce_gradients(p, q, pos, negs, 0.5)[0])
            w[i, j] += 1e-5
            assert g[i, j] == pytest.approx((loss[0] - loss[1]) / 2e-5, rel=1e-4, abs=1e-6)
