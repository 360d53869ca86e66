"""The whole pipeline on a small corpus, stage by stage against what each must do."""

import random

import corpus_pipeline as p
from mhr.llm import mixing, ngram_join
from mhr.llm.common import stored

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    r, rows = random.Random(6), []
    good = lambda n: " ".join("".join(r.choice("bcdfgmnst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n)) + "."
    for i in range(240):
        if i % 6 == 5:
            t = "CLICK HERE !!! " * r.randint(3, 9)
        elif i % 6 == 4:
            t = rows[i - 4][1] + " " + good(1)
        else:
            t = good(r.randint(30, 90))
        rows.append((i, t, "en", "ab"[i % 3 == 0], 0))
    rows[0] = (0, rows[0][1] + " write jo.doe@mail.example.com", "en", "a", 0)
    return [(i, t, la, s, len(t)) for i, t, la, s, _ in rows] + [(900, None, None, None, None), (901, "", "en", "a", 0)]


def test_pipeline(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 6 != 5), 0) for i in range(0, 240) if i % 4 != 1], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for name, stage in p.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), f"t-{name}")
        seen[name] = docs
        assert name == "packing" or docs.columns == columns
    ids = lambda name: {x.doc_id for x in seen[name].select("doc_id").collect()}
    clean = {i for i in range(240) if i % 6 != 5}
    assert len(ids("quality") & clean) >= 0.97 * len(clean) and len(ids("quality") - clean) <= 2
    kept = [(x.doc_id, x.text) for x in seen["quality"].collect()]
    root = {i: i for i, _ in kept}
    for a, b in sorted(ngram_join.brute_force(kept)):
        x, y = root[a], root[b]
        root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    assert ids("near_duplicates") == {i for i, r in root.items() if i == r}
    first = {x.doc_id: x for x in seen["pii"].collect()}
    assert ids("pii") == ids("near_duplicates") and "[EMAIL]" in first[0].text and all(x.n_chars == len(x.text) for x in first.values())
    mixed = {x.doc_id for x in mixing.mix_sources(seen["pii"]).collect()}
    assert ids("mixing") == mixed and mixed <= ids("pii")
    words = {i: len(x.text.split()) for i, x in first.items()}
    got = {}
    for x in docs.collect():
        got[x.doc_id] = got.get(x.doc_id, 0) + x.n_tokens
    assert got == {i: words[i] for i in mixed if words[i]}
    assert {tuple(x) for x in p.run(spark, str(tmp_path)).select("doc_id", "bin_id", "slot").collect()} == {(x.doc_id, x.bin_id, x.slot) for x in docs.collect()}


def test_pipeline_odd_tables(spark, tmp_path):
    """No rows; no labels; repeated rows and columns that clash with the operators' own."""
    empty, bare, odd = (tmp_path / x for x in ("empty", "bare", "odd"))
    labels = "doc_id bigint, quality int, toxic int"
    spark.createDataFrame([], SCHEMA).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], labels).write.parquet(str(empty / "labels.parquet"))
    assert p.run(spark, str(empty)).count() == 0
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(bare / "documents.parquet"))
    spark.createDataFrame([], labels).write.parquet(str(bare / "labels.parquet"))
    docs = spark.read.parquet(str(bare / "documents.parquet"))
    assert p.good_quality(spark, docs, str(bare)).count() == len(rows)
    clash = ", node bigint, size int, len int, key string, p_good double, _row int, copies int, budget int"
    again = [(*r, 1, 2, 3, "k", 0.5, 6, 7, 8) for r in rows[:30] + rows[:10] + [(None, *rows[0][1:]), rows[240]]]
    spark.createDataFrame(again, SCHEMA + clash).write.parquet(str(odd / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 6 != 5), 0) for i in range(30)], labels).write.parquet(str(odd / "labels.parquet"))
    docs = spark.read.parquet(str(odd / "documents.parquet"))
    columns, ids = docs.columns, {}
    for name, stage in p.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(odd)), f"t-{name}")
        assert docs.columns == columns and (not docs.count() or docs.where("size = 2 and budget = 8").count() == docs.count())
        ids[name] = [x.doc_id for x in docs.select("doc_id").collect()]
    assert len(set(ids["near_duplicates"])) == len(ids["near_duplicates"]) and 0 in ids["near_duplicates"] and None in ids["near_duplicates"]
