import random
from collections import Counter

import numpy as np
import pytest

from mhr.llm import ngram_join as j

SCHEMA = "doc_id bigint, text string, node string, sig int"


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            for _ in range(int(len(w) * rng.choice([0, 0.01, 0.03, 0.08]))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 6, 10, 20, 45, 80, 150, 400]))]
        rows.append((i, " ".join(w)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "a", 1) for i, x in rows], SCHEMA)


def all_pairs(docs, n=j.N, t=j.THRESHOLD):
    return {(r.doc_a, r.doc_b) for r in j.expand_pairs(j.ngram_jaccard_join(docs, n, t), j.memberships(docs, n)).collect()}


def classes_of(ids, pairs):
    """(class, links) of each document, by plain Python."""
    root, links = {i: i for i in ids}, {i: 0 for i in ids}
    for a, b in sorted(pairs):
        x, y = root[a], root[b]
        root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
        links[a], links[b] = links[a] + 1, links[b] + 1
    return {i: (root[i], links[i]) for i in ids}


@pytest.mark.parametrize("n,t", [(2, 0.8), (1, 0.9), (3, 0.6)])
def test_equals_brute_force(spark, n, t):
    rows = corpus(n)
    truth = j.brute_force(rows, n, t)
    if n != 1:
        assert all_pairs(frame(spark, rows), n, t) == truth
    got = {r.doc_id: (r.class_id, r.links) for r in j.near_duplicate_classes(frame(spark, rows), n, t).collect()}
    assert got == classes_of([i for i, _ in rows], truth)


def test_large_cluster_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(j, "TILE", 7)
    monkeypatch.setattr(j, "BROADCAST", 0)
    r, base = random.Random(5), [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if r.random() > 0.04 else f"x{r.randrange(99)}" for w in base)) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(5)] + [(3, rows[3][1])] * 4
    truth = j.brute_force(list(dict.fromkeys(rows)))
    got = {x.doc_id: (x.class_id, x.links) for x in j.near_duplicate_classes(frame(spark, rows)).collect()}
    assert len(truth) > 60 and got == classes_of({i for i, _ in rows}, truth)
    kept = sorted(x.doc_id for x in j.drop_near_duplicates(frame(spark, rows)).collect())
    assert kept == sorted({c for c, _ in got.values()})


def test_signatures_of_similar_sets_meet():
    """At every size a pair just similar enough shares signatures, and unlike sets share none that all have."""
    r = np.random.RandomState(3)
    for size in [*range(1, 60), 100, 300, 1000]:
        for _ in range(20):
            differ = int((1 - 0.8) * size)  # the smaller set is contained in the larger
            g = np.sort(r.randint(0, 2**63, size).astype(np.uint64))
            x = g[np.sort(r.permutation(size)[: size - differ])]
            if len(x) == size or len(x) < 0.8 * size:
                continue
            a, b = j.signatures(x, 0.8), j.signatures(g, 0.8)
            both = np.intersect1d(a, b)
            assert len(both) and len(both) >= (both & np.uint64(3)).min(), size
    for size in (4, 10, 15, 22, 31, 40, 80):
        seen = Counter(s for _ in range(400) for s in set(j.signatures(np.sort(r.randint(0, 2**63, size).astype(np.uint64)), 0.8).tolist()))
        assert max(seen.values()) <= 2, size


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "One two"), (5, "one TWO!"), (5, "one TWO!"), (5, "q r s t u v"), (9, "q r s t u v"), (None, "one two"), (6, "x " * 50_000), (7, "x"), (8, "x x")]
    assert all_pairs(frame(spark, rows)) == j.brute_force(rows) == {(4, 5), (5, 9), (6, 8)}
    assert j.ngram_jaccard_join(frame(spark, [])).count() == 0 and j.near_duplicate_classes(frame(spark, [])).count() == 0 and j.drop_near_duplicates(frame(spark, [])).count() == 0
    got = {r.doc_id: (r.class_id, r.links) for r in j.near_duplicate_classes(frame(spark, rows)).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 1), 5: (4, 2), 9: (5, 1), 6: (6, 1), 8: (6, 1), 7: (7, 0)}
    kept = j.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "node", "sig"]
    assert Counter((x.doc_id, (x.text or "-")[:7]) for x in kept.collect()) == Counter([(1, "-"), (2, "-"), (3, "..."), (4, "One two"), (5, "q r s t"), (None, "one two"), (6, "x x x x"), (7, "x")])


def test_groups(spark):
    base = [f"w{i}" for i in range(100)]
    chain = [(k, " ".join(base[k * 4 :] + [f"n{i}" for i in range(k * 4)])) for k in range(6)] + [(9, "quite another text"), (10, None)]
    got = {r.doc_id: r.class_id for r in j.near_duplicate_classes(frame(spark, chain)).collect()}
    assert got == {k: 0 for k in range(6)} | {9: 9, 10: 10}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 70), (55, 70)]
    got = {r.id: r.root for r in j.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 50 for i in (50, 55, 60, 70)}
