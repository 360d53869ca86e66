"""License scan, exact top-k, personal data, quality classifier and HTML extraction."""

import math
import random
import re
from collections import Counter

import numpy as np

from mhr.llm import html_extract, licenses, pii, quality, topk
from mhr.llm.common import hash_of, split_words

DOCS = "doc_id bigint, text string, spans string, score double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], DOCS)


def prose(seed, n=40):
    r = random.Random(seed)
    return " ".join(f"word{r.randrange(500)}" for _ in range(n))


# ---- licenses


def test_licenses_found_with_spans(spark):
    rows = [(i, f"{prose(i)} \u00e9\u00fc {t} {prose(-i)}") for i, t in enumerate(licenses.TEMPLATES.values())] + [(99, prose(99))]
    got = licenses.scan_licenses(docs(spark, rows)).collect()
    text = dict(rows)
    for i, name in enumerate(licenses.TEMPLATES):
        mine = [x for x in got if x.doc_id == i and x.coverage == 1.0]
        assert name in {x.license for x in mine} or (name == "MIT-0" and mine[0].license == "MIT"), name
        for x in mine:
            if x.license == name:
                assert split_words(text[i][x.start : x.end]) == split_words(licenses.TEMPLATES[name])
    assert not [x for x in got if x.doc_id == 99]


def test_licenses_tell_versions_apart():
    index = licenses.Index(licenses.TEMPLATES, 0.8)
    names = lambda text: [index.names[x[0]] for x in licenses.scan(licenses.word_hashes(text), index, 0.8)]
    for name in ("GPL-2.0-or-later", "GPL-3.0-or-later", "AGPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause"):
        assert names(f"{prose(3)} {licenses.TEMPLATES[name]} {prose(4)}") == [name]
    assert names("Released under MIT License") == ["MIT-line"]
    assert names(licenses.TEMPLATES["MIT-warranty"]) == ["MIT-warranty"]
    assert names(" ".join([licenses.TEMPLATES["MIT-line"], prose(5)] * 50)) == ["MIT-line"] * 50


def test_licenses_equal_brute_force(spark):
    """As many edits as coverage admits, and more: changed words, dropped ones, words put in between."""
    r, rows = random.Random(1), []
    for i in range(150):
        w = r.choice(list(licenses.TEMPLATES.values())).split()
        edits = r.choice([0, 1, 2, len(w) // 10, len(w) // 5, len(w) // 3])
        for _ in range(edits):
            k, how = r.randrange(len(w)), r.random()
            if how < 0.7:
                w[k] = f"changed{k}"
            elif how < 0.85:
                del w[k]
            else:
                w.insert(k, "between")
        rows.append((i, f"{prose(i)} {' '.join(w)} {prose(i + 50)}"))
    got = {}
    for x in licenses.scan_licenses(docs(spark, rows)).collect():
        got.setdefault(x.doc_id, []).append((x.license, x.matched_words))
    assert len(got) > 90
    for i, t in rows:
        assert got.get(i, []) == licenses.brute_force(t, licenses.TEMPLATES), i


def test_licenses_odd_rows(spark):
    line = licenses.TEMPLATES["MIT-line"]
    rows = [(1, None), (2, ""), (None, line), (3, line), (3, line), (4, "x " * 100_000 + line), (5, "of the software " * 30_000)]
    got = Counter((x.doc_id, x.license) for x in licenses.scan_licenses(docs(spark, rows)).collect())
    assert got == {(None, "MIT-line"): 1, (3, "MIT-line"): 2, (4, "MIT-line"): 1}
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def test_licenses_ties_and_clashing_columns(spark):
    table = spark.createDataFrame([(1, "alpha beta gamma", "x", 1, 2)], "doc_id bigint, text string, license string, start int, end int")
    got = licenses.scan_licenses(table, {"b": "alpha beta gamma", "a": "alpha beta gamma"}).collect()
    assert [(x.license, x.start, x.end, x.matched_words) for x in got] == [("a", 0, 16, 3)]


# ---- top-k


def brute_top_k(rows, queries, k):
    bags = {i: Counter(split_words(t)) for i, t in rows if i is not None and t is not None}
    sizes = {i: sum(b.values()) for i, b in bags.items() if b}
    n, mean = len(sizes), sum(sizes.values()) / max(1, len(sizes))
    df = Counter(t for b in bags.values() for t in b)
    out = {}
    for q, text in queries:
        want, best = Counter(split_words(text)), []
        for i, b in bags.items():
            s = sum(w * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sizes[i] / mean)) for t, w in want.items() if b[t])
            if any(b[t] for t in want):
                best.append((-round(s, 6), i))
        out[q] = [i for _, i in sorted(best)[:k]]
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 7)  # several passes
    r = random.Random(4)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, " ".join(r.choices(words, k=r.choice([1, 5, 30, 200])))) for i in range(250)] + [(900, None), (901, "")]
    queries = [(q, " ".join(r.choices(words, k=r.choice([1, 3, 12])))) for q in range(20)]
    got = topk.top_k(docs(spark, rows), spark.createDataFrame(queries, "item_id bigint, text string"), 8)
    found = {}
    for x in sorted(got.collect(), key=lambda x: (x.query_id, x.rank)):
        found.setdefault(x.query_id, []).append(x.doc_id)
    assert found == {q: v for q, v in brute_top_k(rows, queries, 8).items() if v}


def test_top_k_odd_rows(spark):
    q = spark.createDataFrame([(1, "aa"), (None, "aa"), (2, None), (3, "zz"), (4, "")], "item_id bigint, text string")
    got = topk.top_k(docs(spark, [(5, "aa bb"), (5, "aa bb"), (None, "aa"), (6, "aa " * 60_000)]), q).collect()
    assert Counter((x.query_id, x.doc_id) for x in got) == {(1, 5): 2, (1, 6): 1}
    assert topk.top_k(docs(spark, []), q).count() == 0 and topk.top_k(docs(spark, [(1, "aa")]), q.where("false")).count() == 0


# ---- personal data


def test_pii_recall_and_precision():
    t, hit, private, false, lines = pii.model(), 0, 0, 0, 0
    for text, spans in pii.sentences(1500, seed=77):
        found = pii.spans_of(text, t)
        private += len(spans)
        hit += sum(any(s < b and e > a for s, e, *_ in found) for a, b in spans)
        lines += not spans
        false += not spans and bool(found)
    assert hit >= 0.97 * private and false <= 0.05 * lines


def test_pii_trees_and_choice_equal_brute_force():
    """Each candidate's probability by walking the trees, and of chosen spans that touch one that covers all of them."""
    t, r = pii.model(), random.Random(12)
    parts = [x for x, _ in pii.sentences(300, seed=41)]
    for _ in range(40):
        text = " ".join(r.sample(parts, 8))
        chosen = {}
        for s, e, k in pii.candidates(text):
            x, score = pii.features(text, s, e, k), t.base
            for f, cut, leaf in zip(t.feature, t.cut, t.leaf):
                at = 0
                while at < len(f):
                    at = 2 * at + (2 if x[f[at]] > cut[at] else 1)
                score += leaf[at - len(f)]
            p = 1 / (1 + math.exp(-max(-30, min(30, t.slope * score + t.shift))))
            if p >= t.threshold[k]:
                chosen[s, e] = max(p, chosen.get((s, e), 0))
        groups = []
        for s, e in sorted(chosen):
            if groups and s < groups[-1][1]:
                groups[-1] = (groups[-1][0], max(e, groups[-1][1]))
            else:
                groups.append((s, e))
        got = pii.spans_of(text, t)
        assert [(s, e) for s, e, *_ in got] == groups
        assert all(abs(q - max(p for (a, b), p in chosen.items() if a >= s and b <= e)) < 1e-6 for s, e, _, q in got)


def test_pii_without_bounds():
    t = pii.model()
    long = "abcdefghij" * 6 + "7" + "QwErTy" * 3
    hidden = lambda text, value: value not in pii.redact(text, pii.spans_of(text, t))
    assert hidden(f"the token: {long} is here", long) and hidden(f"see {long} now", long)
    mail = "a" * 90 + "@" + "b" * 70 + ".example.com"
    assert hidden(f"write to {mail}, please", mail) and hidden("host 2001:db8:85a3::8a2e:370:7334 is up", "2001:db8:85a3::8a2e:370:7334")
    assert pii.candidates("x" * 200_000 + "@" * 3 + "-1" * 50_000 + "a." * 50_000) is not None  # no more than linear


def test_pii_redacts_and_odd_rows(spark):
    rows = [(1, "write to jo.doe@mail.example.com or +1 (212) 555-0188 today"), (2, "version 3.11.2 of 2024-05-06"), (3, None), (4, ""), (None, "x"), (5, "a " * 50_000 + "password=hunter22x9"), (5, "q"), (5, "q")]
    got = pii.redact_pii(docs(spark, rows)).collect()
    by = {x.doc_id: x for x in got}
    assert by[1].text == "write to [EMAIL] or [PHONE] today" and by[2].text == rows[1][1] and by[3].text is None and by[4].text == ""
    assert len(got) == len(rows) and any("hunter22x9" not in (x.text or "hunter22x9") and len(x.text) > 90_000 for x in got if x.doc_id == 5)
    assert pii.redact_column(docs(spark, rows)).columns == [c.split()[0] for c in DOCS.split(", ")]
    assert pii.redact_pii(docs(spark, [])).count() == 0


# ---- quality


def labelled(n, seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("bcdfgmnst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(200)]
    good = lambda: " ".join(r.choices(vocabulary, k=r.randint(8, 60))) + "."
    bad = lambda: r.choice([" ".join([r.choice(["BUY", "now", "!!!"])] * r.randint(5, 40)), "".join(r.choice("#$%&*~") for _ in range(80)), "CLICK HERE " * 9])
    return [(i, good() if i % 2 else bad(), i % 2) for i in range(n)]


def test_quality_held_out(spark):
    rows = labelled(1200, 2)
    table = docs(spark, [(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (None, rows[1][1])])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:600]], "doc_id bigint, quality int")
    got = {x.doc_id: x for x in quality.quality_scores(table, labels).collect()}
    right = sum(got[i].keep == (y == 1) for i, _, y in rows[600:])
    assert right >= 570 and not got[5000].keep and not got[5001].keep and got[None].keep
    kept = quality.keep_good(table, labels)
    assert kept.columns == table.columns and kept.count() == sum(x.keep for x in got.values())
    assert quality.quality_scores(table, labels.where("quality = 1")).where("keep").count() == len(rows) + 3
    assert quality.quality_scores(docs(spark, []), labels).count() == 0


def plain_tokens(text, buckets):
    """Buckets of a text's tokens, by regular expressions."""
    out, last = [], None
    for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\s\0]+", text):
        w = m[0]
        if re.match(r"[0-9A-Za-z\x80-\U0010ffff]", w):
            out.append(int(hash_of(re.sub("[A-Z]", lambda x: x[0].lower(), w))) % (buckets - 2) + 2)
            caps = re.sub("[^A-Z]", "", w)
            if len(caps) >= 2 and not re.search("[a-z]", w):
                out.append(1)
            if last == w.lower():
                out.append(0)
            last = w.lower()
        else:
            h = quality.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), quality._SYMBOL)[0]
            out.append(int(quality.mix(h + np.uint64(1))[0] % np.uint64(buckets - 2)) + 2)
    return out


def test_quality_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 50)
    rows = labelled(120, 3) + [(500, "Aa aa BB !! zz " * 60, 1), (501, "", 1)]
    table, buckets = docs(spark, [(i, t) for i, t, _ in rows]), 1 << 14
    want = np.zeros((buckets, quality.WIDTH))
    for _, t, _ in rows:
        b = plain_tokens(t, buckets)
        for i, x in enumerate(b):
            for j, y in enumerate(b):
                if i != j and abs(i - j) <= quality.WINDOW:
                    for k in range(quality.NONZERO):
                        column, sign = quality.index_entries(np.array([y]), k)
                        want[x, column[0]] += sign[0] * (quality.WINDOW // abs(i - j))
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    got = quality.word_vectors(table, buckets)
    assert np.allclose(got, want, atol=2e-3) and quality.buckets_for(len(rows)) == buckets
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int")
    m = quality.train(table, labels)
    for x in quality.quality_scores(table, labels).collect():
        b = plain_tokens(dict((i, t) for i, t, _ in rows)[x.doc_id], buckets)
        mean = (sum((m.vectors[i].astype(float) for i in b), np.zeros(quality.WIDTH)) + quality.PRIOR * m.prior) / (len(b) + quality.PRIOR)
        hidden = np.tanh((mean - m.mean) / m.scale @ m.w1 + m.b1)
        p = 1 / (1 + math.exp(-max(-30, min(30, (hidden @ m.w2 + m.b2) / m.temperature)))) if b else 0.0
        assert abs(p - x.p_good) < 2e-3 and x.keep == (x.p_good >= 0.5)


def test_quality_does_not_depend_on_row_order(spark):
    rows = labelled(200, 5)
    twice = [(i, t) for i, t, _ in rows] + [(i, t[::-1]) for i, t, _ in rows[:40]]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int")
    score = lambda table: sorted((x.doc_id, x.p_good) for x in quality.quality_scores(table, labels).collect())
    assert score(docs(spark, twice)) == score(docs(spark, twice[::-1]).repartition(3))


def test_quality_clashing_columns(spark):
    rows = labelled(60, 6)
    table = spark.createDataFrame([(i, t, 0.1, False) for i, t, _ in rows], "doc_id bigint, text string, p_good double, keep boolean")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int")
    assert quality.quality_scores(table, labels).columns == ["doc_id", "p_good", "keep"] and quality.keep_good(table, labels).where("p_good = 0.1 and not keep").count() > 0


def test_pooling_in_blocks(monkeypatch):
    r = np.random.RandomState(0)
    v, b, ptr = r.rand(5000, quality.WIDTH).astype(np.float32), r.randint(0, 5000, 900), np.array([0, 0, 3, 10, 700, 700, 900])
    whole = quality.pooled(v, np.zeros(quality.WIDTH), b, ptr)
    monkeypatch.setattr(quality, "BLOCK", 64)
    assert np.allclose(whole, quality.pooled(v, np.zeros(quality.WIDTH), b, ptr), atol=1e-4)


# ---- HTML


def test_marginals_equal_enumeration():
    """Messages give the marginals that summing over all states gives."""
    from itertools import product

    p = html_extract.Pages()
    p.read("<div><p>one two</p><ul><li>three</li></ul></div>", 0)
    f, r = html_extract.forest(p), np.random.RandomState(1)
    m = html_extract.Model(r.randn(html_extract.WIDTH), r.randn(html_extract.EDGES, 2, 2))
    n, weight, total = len(f.parent), np.zeros(len(f.parent)), 0.0
    for state in product((0, 1), repeat=n):
        e = sum((f.x[i] @ m.weights) * s for i, s in enumerate(state)) + sum(m.pair[f.edge[i], state[f.parent[i]], state[i]] for i in range(n) if f.parent[i] >= 0)
        total += math.exp(e)
        weight += math.exp(e) * np.array(state)
    assert np.allclose(m.marginals(f), weight / total)


def test_extraction_held_out():
    m, r, right, runs = html_extract.model(), random.Random(99), 0, 0
    for _ in range(60):
        html, marks = html_extract.labelled_page(r)
        p = html_extract.Pages()
        p.read(html, 0)
        prob = m.marginals(html_extract.forest(p))
        said = [prob[i] >= 0.5 for i, t in enumerate(p.text) if t is not None]
        right += sum(a == b for a, b in zip(said, marks))
        runs += len(marks)
    assert right >= 0.97 * runs


def test_extraction_equals_enumeration(spark):
    """Whole pages: text from marginals by summing over all states, on trees that the standard parser builds."""
    from html.parser import HTMLParser
    from itertools import product

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.path, self.kinds, self.runs = [0], [None], []

        def handle_starttag(self, tag, attrs):
            self.kinds.append(tag)
            self.path.append(len(self.kinds) - 1)

        def handle_endtag(self, tag):
            self.path.pop()

        def handle_data(self, data):
            if data.strip():
                self.kinds.append(None)
                self.runs.append((len(self.kinds) - 1, data.strip()))

    m, r, pages = html_extract.model(), random.Random(8), []
    for i in range(25):
        part = lambda: r.choice(["<p>{}</p>", "<div class=ad>{}</div>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<footer>{}</footer>"]).format(prose(r.random(), r.choice([1, 3, 20])))
        pages.append((i, f"<article>{part()}{part()}</article>{part()}"))
    got = {x.page_id: x for x in html_extract.extract_html(spark.createDataFrame(pages + pages[:3], "page_id bigint, html string")).collect()}
    for i, html in pages:
        tree = Tree()
        tree.feed(html)
        p = html_extract.Pages()
        p.read(html, 0)
        f = html_extract.forest(p)
        n, weight = len(f.parent), 0
        assert n == len(tree.kinds) <= 14
        for state in product((0, 1), repeat=n):
            e = sum((f.x[k] @ m.weights) * s for k, s in enumerate(state) if s) + sum(m.pair[f.edge[k], state[f.parent[k]], state[k]] for k in range(1, n))
            weight = weight + math.exp(e) * np.array([1, *state])
        prob = weight[1:] / weight[0]
        assert got[i].text == "\n".join(t for k, t in tree.runs if prob[k] >= 0.5) and got[i].runs == len(tree.runs)


def test_extraction_of_hidden_and_self_closed_elements():
    m = html_extract.model()
    body = "<p>" + "Some words that are read, and more of them. " * 5 + "</p>"
    words = body[3:-4].strip()
    for between in ('<svg class="i"/>', "<svg-icon>", "<style-guide></style-guide>", "<svg><path d='x'>", "<noscript>", "<template/>", '<iframe src="x"/>', "<svg><text>no</text></svg>", "<noscript><p>no</p></noscript>", "<script>if (a < b) no()</script>", "<template><svg>no</svg></template>"):
        text = html_extract.extract([f"<article>{body}{between}{body}</article>"], m)[0][0]
        assert text == f"{words}\n{words}", between


def test_extraction_of_deep_and_long_pages():
    m = html_extract.model()
    tail = "<p>Deep text of some words, that goes on. And on it goes, for a while.</p>"
    for depth in (150, 205, 400, 5000):
        assert html_extract.extract(["<div>" * depth + tail + "</div>" * depth], m)[0][0] == tail[3:-4], depth
    long = "long words. " * 40_000
    assert html_extract.extract([f"<p>{long}</p>"], m)[0][0] == long.strip()


def test_extraction_odd_rows(spark):
    deep = "<div>" * 3000 + "<p>deep text of some words, that goes on. And on it goes.</p>"
    rows = [(1, None), (2, ""), (3, "<script>x</script><!-- c -->"), (None, "<p>a"), (5, deep), (6, "<p>" + "long words. " * 40_000), (7, "</div></p><li>x<td>"), (5, deep), (8, "<script")]
    every = html_extract.extract_html(spark.createDataFrame([(i, h, 1) for i, h in rows], "page_id bigint, html string, runs int")).collect()
    got = {x.page_id: x for x in every}
    assert got[1].text is None and got[2].text == "" and got[3].text == "" and got[3].certainty is None and len(every) == len(rows)
    assert [x.text for x in every if x.page_id == 5] == ["deep text of some words, that goes on. And on it goes."] * 2 and len(got[6].text) == 12 * 40_000 - 1
    assert html_extract.extract_html(spark.createDataFrame([], "page_id bigint, html string")).count() == 0
