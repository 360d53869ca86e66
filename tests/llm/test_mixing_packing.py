import random
from collections import Counter, defaultdict

import numpy as np

from mhr.llm import mixing, packing

SCHEMA = "doc_id bigint, text string, source string, len int, key string, bin_id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "k", 2) for i, t, s in rows], SCHEMA)


def corpus(n=300, seed=1):
    r = random.Random(seed)
    return [(i, " ".join(["w%d" % r.randrange(50)] * r.choice([1, 2, 3, 7, 20, 55, 130])), r.choice(["a", "a", "a", "b", "c"])) for i in range(n)]


def test_knapsack_is_best():
    r = random.Random(3)
    for _ in range(200):
        lengths = sorted(r.sample(range(1, 30), r.randint(1, 5)))
        counts = [r.randint(0, 4) for _ in lengths]
        budget = r.randint(0, 90)
        take = mixing.knapsack(np.array(lengths), np.array(counts), budget)
        assert (take <= counts).all() and (take * lengths).sum() == mixing.brute_force(lengths, counts, budget)


def test_take_counts():
    r = np.random.RandomState(0)
    lengths, counts = np.arange(1, 400), r.randint(1, 50, 399)
    total = int((lengths * counts).sum())
    for share in (0.2, 0.5, 0.9):
        take = mixing.take_counts(lengths, counts, int(total * share))
        assert (take <= counts).all() and (take * lengths).sum() == int(total * share)


def test_mixture_hits_budgets(spark):
    rows = corpus()
    got = mixing.mix_sources(frame(spark, rows), {"a": 1, "b": 1, "c": 2}, 1600).collect()
    tokens = Counter()
    for x in got:
        tokens[x.source] += x.n_tokens
    words = {i: len(t.split()) for i, t, _ in rows}
    assert all(words[x.doc_id] == x.n_tokens for x in got) and len({x.doc_id for x in got}) == len(got)
    assert tokens == {"a": 400, "b": 400, "c": 800}


def test_mixture_default_uses_scarcest_source_whole(spark):
    rows = corpus()
    got = Counter(x.source for x in mixing.mix_sources(frame(spark, rows), alpha=0.0).collect())
    have = Counter(s for _, _, s in rows)
    assert any(got[s] == have[s] for s in have) and got["a"] < have["a"]


def test_mixing_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "z", "a"), (4, "long " * 30_000, "a")]
    got = Counter((x.doc_id, x.source, x.n_tokens) for x in mixing.mix_sources(frame(spark, rows), {"a": 1, "": 1}, 10**6).collect())
    assert got == {(2, "a", 0): 1, (3, None, 2): 1, (None, "a", 1): 1, (4, "a", 30_000): 1}
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    assert mixing.mix_rows(frame(spark, rows)).columns == [x.split()[0] for x in SCHEMA.split(", ")]


def test_packing(spark):
    rows = corpus() + [(1000, "x " * 450, "a"), (1001, None, "a"), (1002, " ", "a"), (None, "q r", "b"), (None, "q r", "b")]
    got = packing.pack(frame(spark, rows), 100, 120).collect()
    fill, pieces = defaultdict(int), defaultdict(list)
    for x in got:
        fill[x.bin_id] += x.n_tokens
        pieces[x.doc_id].append((x.start, x.n_tokens))
    assert all(fill[x.bin_id] == x.fill <= 100 for x in got)
    for i, t, _ in rows[:-2]:
        n = len((t or "").split())
        assert sum(k for _, k in pieces.get(i, [])) == n and sorted(s for s, _ in pieces.get(i, [])) == list(range(0, n, 100))
    assert len(pieces[None]) == 2
    total = sum(fill.values())
    assert len(fill) <= total / 100 * 1.05 + 3
    assert packing.pack(frame(spark, [])).count() == 0


def test_local_search_empties_bins():
    sizes = [6, 4, 5, 5, 3, 3, 4]
    bins = [[0], [1, 4], [2], [3, 5], [6]]
    better = packing.local_search([b[:] for b in bins], sizes, 10)
    assert sorted(i for b in better for i in b) == list(range(7)) and len(better) == 3
    r = random.Random(5)
    for _ in range(30):
        sizes = [r.randint(30, 70) for _ in range(60)]
        before = packing.best_fit(sizes, 100)
        after = packing.local_search([b[:] for b in before], sizes, 100)
        square = lambda bs: sum(sum(sizes[i] for i in b) ** 2 for b in bs)
        assert len(after) <= len(before) and square(after) >= square(before) and sorted(i for b in after for i in b) == list(range(60))
        assert all(sum(sizes[i] for i in b) <= 100 for b in after)


def test_small_source_does_not_shrink_the_mixture(spark):
    rows = [(100 * k + i, "w " * 10, f"s{k}") for k in range(20) for i in range(20)] + [(9000, "w", None)]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    tokens = Counter()
    for x in got:
        tokens[x.source] += x.n_tokens
    assert sum(tokens.values()) >= 0.94 * 4001 and tokens[None] == 1
    raw = {s: t**0.7 for s, t in [(None, 1), *((f"s{k}", 200) for k in range(20))]}
    want = {s: int(4001 * w / sum(raw.values()) + 1e-6) for s, w in raw.items()}
    assert all(x.budget == want[x.source] and x.shortfall == max(0, want[x.source] - (200 if x.source else 1)) for x in got)
    assert any(x.shortfall > 0 for x in got)


def improving(a, b, sizes, capacity):
    """Whether a move of one, or exchange one for one or two for one, raises the sum of squared fills of two bins."""
    fa, fb = sum(sizes[i] for i in a), sum(sizes[i] for i in b)
    sums = lambda x: {0: {0}, 1: {sizes[i] for i in x}, 2: {sizes[i] + sizes[j] for k, i in enumerate(x) for j in x[:k]}}
    sa, sb = sums(a), sums(b)
    for m, n in ((1, 0), (0, 1), (1, 1), (2, 1), (1, 2)):
        for d in (s - t for s in sa[m] for t in sb[n]):
            if fa - d <= capacity and fb + d <= capacity and (fa - d) ** 2 + (fb + d) ** 2 > fa**2 + fb**2:
                return True
    return False


def test_no_improving_exchange_is_left():
    r = random.Random(8)
    for low, high, n in ((300, 1500, 900), (600, 1400, 900), (20, 60, 500), (1, 2047, 300)):
        sizes = [r.randint(low, high) for _ in range(n)]
        before = packing.best_fit(sizes, 2048)
        after = packing.local_search([b[:] for b in before], sizes, 2048)
        assert sorted(i for b in after for i in b) == list(range(n)) and len(after) <= len(before)
        assert all(sum(sizes[i] for i in b) <= 2048 for b in after)
        assert not any(improving(a, b, sizes, 2048) for k, a in enumerate(after) for b in after[:k])


def test_mixing_equals_brute_force(spark, monkeypatch):
    """Each source's tokens are the best that any choice reaches, and of each length the documents of least hash go in."""
    monkeypatch.setattr(mixing, "RANKED", 4)  # histograms of the hashes
    rows = corpus(400, 5) + corpus(400, 5)[:50]
    table, weights, total = frame(spark, rows), {"a": 2, "b": 1, "c": 1}, 6000
    key = {(x.doc_id, x.source): x.k for x in table.select("doc_id", "source", mixing._key(table.text, table.doc_id, mixing.SEED).alias("k")).collect()}
    got = mixing.mix_sources(table, weights, total).collect()
    distinct = set(rows)
    for source, w in weights.items():
        size = {i: len(t.split()) for i, t, s in distinct if s == source}
        mine = Counter(x.doc_id for x in got if x.source == source)
        counts = Counter(size.values())
        best = mixing.brute_force(list(counts), list(counts.values()), total * w // 4)
        assert set(mine.values()) == {1} and sum(size[i] for i in mine) == best
        for length in counts:
            ranked = sorted((i for i in size if size[i] == length), key=lambda i: key[i, source])
            taken = [i for i in ranked if i in mine]
            assert taken == ranked[: len(taken)]


def test_mixing_repeated_rows_keep_the_weights(spark):
    rows = [(1, "w " * 50, "a")] * 60 + [(100 + i, f"u{i} " * 10, "a") for i in range(40)] + [(300 + i, f"v{i} " * 10, "b") for i in range(40)]
    got = Counter()
    for x in mixing.mix_sources(frame(spark, rows), {"a": 1, "b": 1}, 300).collect():
        got[x.source] += x.n_tokens
    assert got == {"a": 150, "b": 150}


def test_mixing_ties_and_clashing_columns(spark):
    table = spark.createDataFrame([(i, f"t{i} x", "a", 1, 2, 3) for i in range(50)], "doc_id bigint, text string, source string, budget int, take int, copies int")
    got = mixing.mix_rows(table, {"a": 1}, 41)
    assert got.columns == table.columns and got.count() == 20
    assert {x.doc_id for x in mixing.mix_sources(table, {"a": 1}, 41).collect()} == {x.doc_id for x in got.collect()}


def test_long_document_leaves_the_programme_small():
    lengths, counts = np.array([1, 7, 10_000_000]), np.array([500, 300, 2])
    take = mixing.take_counts(lengths, counts, 12_000_001)
    assert (take <= counts).all() and (take * lengths).sum() == 10_002_600 and take[2] == 1


def plain_best_fit(sizes, capacity):
    bins = []
    for i in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        fits = [(capacity - sum(sizes[x] for x in b), k) for k, b in enumerate(bins) if sum(sizes[x] for x in b) + sizes[i] <= capacity]
        if fits:
            bins[min(fits)[1]].append(i)
        else:
            bins.append([i])
    return bins


def least_bins(sizes, capacity):
    best = len(sizes)

    def place(i, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(sizes):
            best = len(fills)
            return
        for k in range(len(fills)):
            if fills[k] + sizes[i] <= capacity and fills[k] not in fills[:k]:
                place(i + 1, fills[:k] + [fills[k] + sizes[i]] + fills[k + 1 :])
        place(i + 1, fills + [sizes[i]])

    place(0, [])
    return best


def test_packing_against_brute_force(spark):
    r = random.Random(11)
    for _ in range(40):
        sizes = [r.randint(1, 40) for _ in range(60)]
        assert packing.best_fit(sizes, 50) == plain_best_fit(sizes, 50)
    near = 0
    for _ in range(60):
        sizes = sorted((r.randint(5, 45) for _ in range(11)), reverse=True)
        mine, least = len(packing.local_search(packing.best_fit(sizes, 50), sizes, 50)), least_bins(sizes, 50)
        assert least <= mine <= least + 1
        near += mine == least
    assert near >= 50
    rows = [(i, "w " * r.choice([3, 20, 31, 44, 60, 130]), "a") for i in range(90)]
    bins = defaultdict(list)
    for x in packing.pack(frame(spark, rows), 50, 1000).collect():
        bins[x.bin_id].append(x.n_tokens)
    flat = [s for b in bins.values() for s in b]
    at = iter(range(len(flat)))
    numbered = [[next(at) for _ in b] for b in bins.values()]
    assert sorted(flat) == sorted(min(50, n - k) for n in (len(t.split()) for _, t, _ in rows) for k in range(0, n, 50))
    assert not any(improving(a, b, flat, 50) for k, a in enumerate(numbered) for b in numbered[:k])


def test_repeated_rows_are_spread_over_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 1000)
    table = spark.range(100_000).selectExpr("7L as doc_id", "'a b c d e' as text")
    got = packing.pack(table, 100, 5000).selectExpr("shiftright(bin_id, 32) as g", "n_tokens", "fill").groupBy("g").count().collect()
    assert sum(x["count"] for x in got) == 100_000 and len(got) == 20 and max(x["count"] for x in got) < 5600


def test_very_long_document_at_the_default_capacity(spark):
    got = packing.pack(frame(spark, [(1, "w " * 300_000, "a"), (2, "x", "a")])).collect()
    assert sum(x.n_tokens for x in got if x.doc_id == 1) == 300_000 and {x.start for x in got if x.doc_id == 1} == set(range(0, 300_000, 2048))
