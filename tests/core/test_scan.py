import numpy as np
import pytest
from pyspark.sql import functions as F

from mhr.functions import vectors as V
from mhr.operators import fusion, search
from mhr.operators.scan import Best, Block


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark, x, key, *names):
    return spark.createDataFrame([(i, *[v.tolist()] * len(names)) for i, v in enumerate(x)], f"{key} bigint, " + ", ".join(f"{n} array<double>" for n in names))


@pytest.mark.parametrize("metric", ["cosine", "dot_product", "l2", 2])
def test_best_equals_brute_force(metric):
    """Single-precision bounds lose nothing: near copies, ties, zero rows, large and small norms, blocks in any order, some queries left out."""
    r = np.random.RandomState(1)
    docs = r.randn(900, 6)
    docs[300:600] = docs[:300] + 1e-8 * r.randn(300, 6)
    docs[600:700] = docs[:100]
    docs[700:720] = 0
    if metric == "dot_product":
        docs[800:] *= 10.0 ** r.randint(-6, 7, (100, 1))
    asked = np.concatenate([docs[:40], docs[700:703], r.randn(20, 6)])
    if metric == "cosine":
        docs, asked = search.unit_rows(docs), search.unit_rows(asked)
    ids = r.permutation(900) * 3
    s = -np.linalg.norm(asked[:, None] - docs[None], axis=2) if metric == "l2" else np.einsum("ij,kj->ik", asked, docs)
    s = np.round(np.clip(s, -1, 1) if metric == "cosine" else s, 9)
    s = (np.round(s / 2, 9) if metric == 2 else s) + 0.0
    best, of = Best(asked, metric, 7), np.arange(5, len(asked))
    for lo in range(0, 900, 64):
        best.add(Block(ids[lo : lo + 64], docs[lo : lo + 64], metric), None if lo < 512 else of)
    best.merge()
    for q in range(len(asked)):
        seen = 900 if q >= 5 else 512
        order = np.lexsort((ids[:seen], -s[q, :seen]))[:7]
        assert list(best.ids[best.r == q]) == list(ids[order])
        assert best.s[best.r == q] == pytest.approx(s[q, order], rel=1e-12, abs=2e-9)


def test_blocks_are_not_multiplied_out(spark):
    """Neither exact search nor the index joins blocks with blocks, and lists are shuffled once for all that follows."""
    x = np.random.RandomState(2).randn(200, 8)
    docs, qs = table(spark, x, "doc_num", "a", "b"), table(spark, x, "qid", "a", "b")
    for df in (search.head_lists(docs, qs, ["a", "b"], 5), search.ground_truth(docs, qs, ["a", "b"], 5)):
        assert "Cartesian" not in plan(df) and "Join" not in plan(df)


def test_ground_truth_ranks_by_the_rounded_mean(spark):
    """Sums that differ by less than the mean shows are ties, which go to the smaller id, as in SQL."""
    at = lambda c: [c, (1 - c * c) ** 0.5]
    docs = spark.createDataFrame([(1, at(0.500000001), at(0.25), at(0.2)), (2, at(0.500000002), at(0.25), at(0.2)), (3, at(0.500000003), at(0.25), at(0.2)), (4, at(0.5), at(0.25), at(0.2))], "doc_num bigint, a array<double>, b array<double>, c array<double>")
    q = spark.createDataFrame([(0, *[[1.0, 0.0]] * 3)], "qid bigint, a array<double>, b array<double>, c array<double>")
    sums = {1: 0.950000001, 2: 0.950000002, 3: 0.950000003, 4: 0.95}
    want = sorted(sums, key=lambda d: (-round(sums[d] / 3, 9), d))
    got = [r.doc_num for r in search.ground_truth(docs, q, ["a", "b", "c"], 4).orderBy("rank").collect()]
    assert got == want and want != sorted(sums, key=lambda d: -sums[d])


def test_lists_to_fuse_hold_all_that_may_win(spark):
    """Few rows go on to fusion, and with them it gives what whole lists give."""
    x = np.random.RandomState(4).randn(400, 8)
    x[300:] = -x[:100]  # scores below zero
    docs = table(spark, x, "doc_num", "a", "b").selectExpr("doc_num", "a", "CASE WHEN doc_num % 3 > 0 THEN reverse(b) END AS b")
    qs = table(spark, x[:120], "qid", "a", "b").selectExpr("qid", "a", "CASE WHEN qid % 7 > 0 THEN b END AS b")
    whole, some = fusion.max_normalised(search.head_lists(docs, qs, ["a", "b"], 50)), search.lists_to_fuse(docs, qs, {"a": 0.7, "b": 0.3}, 50, 5)
    w = search.weight_of(F.col("head"), {"a": 0.7, "b": 0.3})
    assert sorted(map(tuple, fusion.fuse(whole, w, 5).collect())) == sorted(map(tuple, fusion.fuse(some, w, 5).collect()))
    assert some.count() < whole.count() / 4


def test_products_are_made_a_piece_at_a_time():
    """A tile of queries against a block needs a few MB, whatever is kept equals brute force, and a row that is no number hides no other."""
    import tracemalloc

    r = np.random.RandomState(6)
    docs, asked = search.unit_rows(r.randn(8192, 16)), search.unit_rows(r.randn(2048, 16))
    docs[4100] = np.nan
    first, second = Block(np.arange(4096), docs[:4096], "cosine"), Block(np.arange(4096, 8187), docs[4096:8187], "cosine")
    best = Best(asked, "cosine", 5)
    best.add(first)
    best.merge()
    tracemalloc.start()
    best.add(second)
    best.merge()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s = np.where(np.isnan(docs[:8187, 0]), -2, np.round(asked @ np.nan_to_num(docs[:8187]).T, 9))
    assert (best.ids.reshape(-1, 5) == np.argsort(-s, axis=1, kind="stable")[:, :5]).all()
    assert peak < 16 << 20


def two_heads(spark):
    x = np.random.RandomState(7).randn(300, 8)
    x[250:] = -x[:50]
    docs = table(spark, x, "doc_num", "a", "b").selectExpr("doc_num", "a", "CASE WHEN doc_num % 3 > 0 THEN reverse(b) END AS b")
    return docs, table(spark, x[:90], "qid", "b", "a")


def test_pooled_heads_are_cut_before_the_shuffle(spark):
    """Each task sends on the k first of all heads, in either order, and the result is that of whole lists."""
    docs, qs = two_heads(spark)
    whole = search.head_lists(docs, qs, ["b", "a"], 10).drop("rank").collect()
    for weights in (None, {"a": 0.4}):
        for ascending in (False, True):
            got = search.search_multi(docs, qs, ["b", "a"], 5, weights, ascending)
            want = []
            for q in range(90):
                rows = [(r.score * (weights or {}).get(r.head, 1.0), r.head, r.doc_num) for r in whole if r.qid == q]
                want += [(q, i + 1, h, d, s) for i, (s, h, d) in enumerate(sorted(rows, key=lambda r: (r[0] if ascending else -r[0], r[1], r[2]))[:5])]
            assert sorted(map(tuple, got.collect())) == want
    pool = search._lists(docs, qs, ["b", "a"], 10, "cosine", keep=lambda q, h, d, s, _: search._first_of_all(q, h, d, s, np.ones(2), np.array([1, 0]), 5, -1))
    assert pool.count() == 90 * 5


def test_sums_over_the_best_need_few_rows(spark):
    docs, qs = two_heads(spark)
    w = {"a": 1.0, "b": 0.5}
    whole, some = search.head_lists(docs, qs, list(w), 20), search.lists_to_fuse(docs, qs, w, 20, 5, normal=False)
    assert sorted(map(tuple, fusion.fuse_by_best(whole, w, 5).collect())) == sorted(map(tuple, fusion.fuse_by_best(some, w, 5).collect()))
    assert some.count() < whole.count() / 2


def test_gates_cut_lists_before_the_shuffle(spark):
    """Weights of each query, some missing: few rows go on, and fusion gives what whole lists give."""
    docs, qs = two_heads(spark)
    gates = spark.createDataFrame([(q, h, None if (q % 11, h) == (3, "a") else (q % 7 + 1) / (9.0 if h == "a" else 5.0)) for q in range(85) for h in "ab" if (q % 5, h) != (0, "b")], "qid bigint, head string, gate double")
    lists = fusion.max_normalised(search.head_lists(docs, qs, ["a", "b"], 50)).join(gates, ["qid", "head"])
    for least in (None, 0.5):
        want = fusion.fuse(lists if least is None else lists.where(F.col("gate") >= least), F.col("gate"), 10)
        assert sorted(map(tuple, want.collect())) == sorted(map(tuple, fusion.attend(docs, qs, ["a", "b"], gates=gates, min_weight=least).collect()))
    some = search.lists_to_gate(docs, qs, ["a", "b"], gates.withColumnRenamed("gate", "w"), 50, 10)
    assert some.count() < lists.count() / 3


def test_gates_make_each_logit_once(spark):
    """The net's matrix stands once in the plan's expression of the gates, which are right, and nulls for a null vector."""
    w = [[0.5, -1.0], [2.0, 0.25]]
    qs = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "qid bigint, vec array<double>")
    one = qs.select("qid", V.softmax(V.project(F.col("vec"), w)).alias("g"))
    z = np.array(w) @ [1.0, 2.0]
    got = {r.qid: r.g for r in one.collect()}
    assert got[1] == pytest.approx(list(np.exp(z) / np.exp(z).sum())) and got[2] == [None, None]
    assert one._jdf.queryExecution().optimizedPlan().toString().count("0.25") <= 1
