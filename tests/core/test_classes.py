import numpy as np
import pytest
from pyspark.sql import functions as F

from mhr.operators import fusion, metrics, search


def labelled(spark, n=240):
    r = np.random.RandomState(5)
    rows = [(i, r.randn(6).tolist(), int(x) if x else None) for i, x in enumerate(r.randint(0, 5, n))] + [(n, None, 1), (n + 1, [1.0] * 6, 9)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>, label int")


def rows(df):
    return sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_rerank_within_equals_listed_candidates(spark):
    e = labelled(spark)
    docs, qs = e.withColumnRenamed("id", "doc_num"), e.withColumnRenamed("id", "qid")
    pairs = docs.select("doc_num", "label").join(qs.select("qid", "label"), "label").select("qid", "doc_num")
    want = search.rerank_exact(pairs, docs.dropna(), qs.dropna(), 7)
    got = search.rerank_within(docs, qs, "label", 7)
    assert rows(got) == rows(want) and "Join" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("within", [0, 10])
def test_quality_by_class_equals_listed_pairs(spark, within):
    ids = labelled(spark).select("id", "label").union(spark.createDataFrame([(3, 2), (7, 7)], "id bigint, label int"))  # two labels of one id
    r = np.random.RandomState(6)
    found = spark.createDataFrame([(q, rank + 1, int(d)) for q in range(250) for rank, d in enumerate(r.permutation(245)[:12])], "qid bigint, rank bigint, doc_num bigint")
    pairs = ids.withColumnRenamed("id", "qid").join(ids.withColumnRenamed("id", "doc_num"), "label").where("qid <> doc_num")
    relevant = pairs.select("qid", "doc_num", F.when(F.abs(F.col("qid") - F.col("doc_num")) <= within, 2).otherwise(1).alias("grade"))
    assert rows(metrics.quality_by_class(found, ids, 10, within)) == rows(metrics.quality(found, relevant, 10))


def test_quality_by_class_lists_no_pairs(spark):
    """One label of 20,000 ids: its 400 million pairs would not end."""
    ids = spark.range(20_000).select("id", F.lit(1).alias("label"))
    found = spark.range(20_000).select(F.col("id").alias("qid"), F.lit(1).cast("bigint").alias("rank"), ((F.col("id") + 1) % 20_000).alias("doc_num"))
    got = metrics.quality_by_class(found, ids, 10, 10).agg(F.count("*"), F.min("precision"), F.max("recall")).first()
    assert tuple(got) == (20_000, 0.1, pytest.approx(1 / 19_999, abs=1e-9))


def test_consensus_and_two_weightings(spark):
    r = np.random.RandomState(7)
    lists = spark.createDataFrame([(q, h, int(d), float(np.round(r.rand(), 3)), i + 1) for q in range(6) for h in "ab" for i, d in enumerate(r.permutation(9)[:5])], "qid bigint, head string, doc_num bigint, score double, rank bigint")
    a, b = (lists.where(F.col("head") == h) for h in "ab")
    want = np.mean([len({x.doc_num for x in a.where(f"qid = {q} AND rank <= 4").collect()} & {x.doc_num for x in b.where(f"qid = {q} AND rank <= 4").collect()}) for q in range(6)])
    assert metrics.consensus(a, b, 4).first()[0] == pytest.approx(want, abs=1e-6)
    one, two = search.weight_of(F.col("head"), {"a": 0.9, "b": 0.1}), F.lit(0.5)
    for got, w in zip(fusion.fuse_both(lists, one, two, 3), (one, two)):
        assert rows(got) == rows(fusion.fuse(lists, w, 3))
