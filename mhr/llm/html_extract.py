"""Operator 1: main text of web pages by a tree-structured graphical model.

Every element and text run of the DOM is a binary variable, content or not, with a log-linear potential of its features;
parent-child potentials depend on the kind of edge.  Sum-product messages go up from the leaves and down from the root,
all nodes of a depth at once over a batch of pages, and give exact content marginals.  Trees of any depth are read whole;
memory goes with the nodes of a batch, at most BYTES of pages or one longer page.  The weights maximise the likelihood
of labelled pages (expected counts come from the same messages); the pages are seeded and made here.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES, STEPS, THRESHOLD = 240, 250, 0.5
#: Characters of pages that are worked on together.
BYTES = 2 << 20

_ATTRS = r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*+"
_RAW = r"(?:script|style|textarea|iframe)(?=[\s/>])"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<{_RAW}{_ATTRS}(?<=/)>|<({_RAW}).*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)({_ATTRS})>|<[!?][^>]*>|([^<]+)|<", re.S | re.I
)
#: Elements whose text isn't shown.
_HIDDEN = ("svg", "template", "noscript")
_HINT = re.compile(r"(?:class|id|role)\s*=\s*[\"']?([^\"'>]*)", re.I)
_BAD = re.compile(r"\b(?:ad|ads|advert\w*|banner|nav\w*|menu|foot\w*|side\w*|social|share\w*|cookie\w*|comment\w*|promo\w*|related|widget|breadcrumb\w*|login|search|subscribe|newsletter)\b", re.I)
_GOOD = re.compile(r"\b(?:article\w*|content|post\w*|entry|main|story|body\w*|text)\b", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul br title head".split())
_ENDS_P = _BLOCK - {"br", "body", "html", "td", "th", "li", "dd", "dt", "title", "head"}
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table body html #root".split())
_GROUPS = {t: g for g, ts in enumerate(("p pre blockquote", "article main section", "div span", "nav ul ol li menu", "header footer aside", "h1 h2 h3 h4 h5 h6", "a", "table tr td th tbody", "form button input label select option", "title head meta", "b i em strong code u small sub sup")) for t in ts.split()}
_OTHER = len(set(_GROUPS.values()))
_TEXT = _OTHER + 1
_EXTRA = 14
WIDTH, EDGES = _TEXT + 1 + _EXTRA, 5


class Pages:
    """Nodes of a batch of pages, parents before children."""

    def __init__(self):
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.group: list[int] = []
        self.hint: list[int] = []  # 1: speaks against content, 2: for, 3: both
        self.chars: list[int] = []
        self.words: list[int] = []
        self.stops: list[int] = []
        self.linked: list[int] = []
        self.tags: list[int] = []
        self.page: list[int] = []
        self.text: list[str | None] = []
        self.block: list[int] = []

    def _add(self, parent: int, group: int, hint: int, page: int, text: str | None, block: int, linked: bool) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.group.append(group)
        self.hint.append(hint)
        n = len(text) if text else 0
        self.chars.append(n)
        self.words.append(text.count(" ") + 1 if text else 0)
        self.stops.append(text.count(".") + text.count(",") if text else 0)
        self.linked.append(n if linked else 0)
        self.tags.append(0 if text else 1)
        self.page.append(page)
        self.text.append(text)
        self.block.append(block)
        return len(self.parent) - 1

    def read(self, html: str, page: int) -> None:
        """Adds one page; unclosed, stray and misnested tags are repaired as browsers mostly do.

        Text in svg, template and noscript elements is left out, up to their end tag or that of an element around them; a
        block inside svg ends it.  One that is closed in itself, or has no end tag behind it, holds nothing.
        """
        stack, block = _Open(self._add(-1, _OTHER, 0, page, None, 0, False)), 0
        last_end: dict[str, int] = {}
        for m in _TOKEN.finditer(html):
            text, name = m[5], m[3]
            if text is not None:
                text = text.strip()
                if text and not any(stack.at.get(h) for h in _HIDDEN):
                    self._add(stack.nodes[-1], _TEXT, 0, page, text, block, bool(stack.at.get("a")))
                continue
            if name is None:
                continue
            name = name.lower()
            if name in _BLOCK:
                block += 1
            if m[2]:
                if stack.at.get(name):
                    stack.cut(stack.at[name][-1])
                continue
            scope = stack.scopes[-1]
            if name in _BLOCK and stack.at.get("svg"):
                stack.cut(stack.at["svg"][0])
                scope = stack.scopes[-1]
            if name in _ENDS_P and stack.at.get("p") and stack.at["p"][-1] > scope:
                stack.cut(stack.at["p"][-1])
            for old in _CLOSES.get(name, ()):
                if stack.at.get(old) and stack.at[old][-1] > scope:
                    stack.cut(stack.at[old][-1])
            hint = 0
            if m[4]:
                for h in _HINT.findall(m[4]):
                    hint |= bool(_BAD.search(h.replace("_", " "))) | 2 * bool(_GOOD.search(h.replace("_", " ")))
            node = self._add(stack.nodes[-1], _GROUPS.get(name, _OTHER), hint, page, None, block, False)
            if name in _HIDDEN:
                if name not in last_end:
                    ends = list(re.finditer(rf"</{name}(?=[\s/>])", html, re.I))
                    last_end[name] = ends[-1].start() if ends else -1
                if last_end[name] < m.start():
                    continue
            if name not in _VOID and not m[4].endswith("/"):
                stack.push(name, node)


class _Open:
    """Open elements: their nodes and names, and at which heights each name, and those that bound others, stand."""

    def __init__(self, root: int):
        self.nodes, self.names, self.at, self.scopes = [root], ["#root"], {"#root": [0]}, [0]

    def push(self, name: str, node: int) -> None:
        self.at.setdefault(name, []).append(len(self.nodes))
        if name in _SCOPE:
            self.scopes.append(len(self.nodes))
        self.nodes.append(node)
        self.names.append(name)

    def cut(self, height: int) -> None:
        """Closes the elements from `height` up."""
        while len(self.nodes) > height:
            self.nodes.pop()
            name = self.names.pop()
            self.at[name].pop()
            if name in _SCOPE:
                self.scopes.pop()


@dataclass
class Forest:
    parent: np.ndarray
    levels: list[np.ndarray]
    group: np.ndarray
    extra: list[np.ndarray]
    edge: np.ndarray

    @property
    def x(self) -> np.ndarray:
        """All features as a matrix, for training."""
        out = np.zeros((len(self.parent), WIDTH))
        out[np.arange(len(out)), self.group] = 1
        out[:, _TEXT + 1 :] = np.stack(self.extra, 1)
        return out

    def score(self, weights: np.ndarray) -> np.ndarray:
        """x @ weights, without the matrix."""
        out = weights[self.group]
        for w, e in zip(weights[_TEXT + 1 :], self.extra):
            out += w * e
        return out


def forest(p: Pages) -> Forest:
    """Arrays, features and edge kinds of a batch."""
    parent, depth, group = np.array(p.parent, np.int64), np.array(p.depth, np.int64), np.array(p.group, np.int64)
    n = len(parent)
    own = np.array([p.chars, p.words, p.stops, p.linked, p.tags], float).reshape(5, n)
    below = own.copy()
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(int(depth.max(initial=-1)) + 2))
    levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]
    for lv in levels[:0:-1]:
        for row in below:
            np.add.at(row, parent[lv], row[lv])
    up = np.maximum(parent, 0)
    hint = np.array(p.hint, np.int64)
    bad, good = (hint & 1).astype(float), (hint >> 1).astype(float)
    for lv in levels[1:]:
        bad[lv], good[lv] = np.maximum(bad[lv], 0.7 * bad[parent[lv]]), np.maximum(good[lv], 0.7 * good[parent[lv]])
    chars = np.maximum(below[0], 1)
    listed = np.isin(group, (3, 4)).astype(float)
    for lv in levels[1:]:
        listed[lv] = np.maximum(listed[lv], listed[parent[lv]])
    extra = [np.ones(n), np.log1p(below[0]) / 5, np.log1p(below[1]) / 4, below[3] / chars, np.minimum(below[2] / np.maximum(below[1], 1), 0.5) * 2, np.minimum(below[4] / chars * 20, 2), bad, good, listed, np.minimum(depth, 20) / 10, (group[up] == 0).astype(float), (group[up] == 6).astype(float), np.log1p(below[0][up]) / 8, below[3][up] / chars[up]]
    edge = np.select([group == _TEXT, np.isin(group, (6, 10)), np.isin(group, (3, 4, 8, 9)), np.isin(group, (0, 5))], [0, 1, 2, 3], 4)
    return Forest(parent, levels, group, extra, edge)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis)
    return m + np.log(np.exp(a - np.expand_dims(m, axis)).sum(axis))


def messages(f: Forest, unary: np.ndarray, pair: np.ndarray, edges: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Sum-product: (node log beliefs, edge log beliefs [parent state, child state], if asked for), neither normalised.
    unary: (n, 2); pair: (EDGES, 2, 2)."""
    inner, up, down = unary.copy(), np.zeros_like(unary), np.zeros_like(unary)
    for lv in f.levels[:0:-1]:
        up[lv] = _lse(pair[f.edge[lv]] + inner[lv][:, None, :], 2)
        for s in (0, 1):
            np.add.at(inner[:, s], f.parent[lv], up[lv, s])
    joint = np.zeros((len(unary), 2, 2)) if edges else None
    for lv in f.levels[1:]:
        theta, rest = pair[f.edge[lv]], inner[f.parent[lv]] + down[f.parent[lv]] - up[lv]
        down[lv] = _lse(theta + rest[:, :, None], 1)
        if edges:
            joint[lv] = theta + rest[:, :, None] + inner[lv][:, None, :]
    return inner + down, joint


def _normal(a: np.ndarray) -> np.ndarray:
    flat = a.reshape(len(a), -1)
    e = np.exp(flat - flat.max(1, keepdims=True))
    return (e / e.sum(1, keepdims=True)).reshape(a.shape)


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray

    def marginals(self, f: Forest) -> np.ndarray:
        """Probability of content of each node."""
        unary = np.stack([np.zeros(len(f.parent)), f.score(self.weights)], 1)
        return _normal(messages(f, unary, self.pair, False)[0])[:, 1]


# ---- labelled pages


def labelled_page(r: random.Random) -> tuple[str, list[bool]]:
    """A page, and for each of its text runs in order whether it is content."""
    out: list[str] = []
    marks: list[bool] = []
    word = lambda: "".join(r.choice("bcdfghlmnprst") + r.choice("aeiouéü") for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=2, b=16: words(a, b).capitalize() + r.choice([".", ".", ".", ",", " &amp;&amp;&amp;"])

    def say(text: str, content: bool) -> str:
        marks.append(content)
        return text

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{say(words(1, 2), False)}</a></li>' for _ in range(n))

    def paragraph() -> str:
        tail = r.random()
        text = " ".join(sentence() for _ in range(r.choice([1, 1, 2, 4, 8])))
        if tail < 0.15:
            return f"<p><b>{say(text, True)}<br>"
        if tail < 0.25:
            return f'<p>{say(text, True)} <a href="#">{say(words(1, 3), True)}</a> {say(sentence(), True)}</p>'
        if tail < 0.3:
            return f"<blockquote>{say(text, True)}</blockquote>"
        if tail < 0.35:
            return f"<ul><li>{say(text, True)}</li><li>{say(sentence(4, 20), True)}</li></ul>"
        if tail < 0.4:
            return f"<h2>{say(words(2, 5), True)}</h2><p>{say(text, True)}</p>"
        if tail < 0.44:
            return f"<table><tr><td>{say(words(1, 3), True)}</td><td>{say(text, True)}</td></tr></table>"
        return f"<p>{say(text, True)}</p>"

    out.append(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{say(sentence(), False)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>')
    top = [lambda: f"<nav><ul>{links(r.randint(3, 9))}</ul></nav>", lambda: f'<div class="{r.choice(["menu", "navbar", "top-nav", "x1"])}"><ul>{links(r.randint(3, 9))}</ul></div>', lambda: f'<header><h2>{say(words(1, 3), False)}</h2><p>{say(words(2, 6), False)}</p></header>']
    side = [
        lambda: f'<!-- ad {r.random()} --><div class="{r.choice(["ad", "advert", "banner"])}">{say(sentence(), False)}</div>',
        lambda: f'<aside><h3>{say(words(1, 3), False)}</h3><ul>{links(r.randint(2, 6))}</ul></aside>',
        lambda: f'<div class="{r.choice(["social", "share", "cookie-notice"])}"><span>{say(words(1, 4), False)}</span><button>{say(word(), False)}</button></div>',
        lambda: f'<form><label>{say(words(1, 2), False)}</label><input name="q"><button>{say(word(), False)}</button></form>',
        lambda: f'<div class="comments"><h3>{say(words(1, 2), False)}</h3><p>{say(sentence(), False)}</p></div>',
    ]
    for part in r.sample(top, r.randint(1, 2)) + [r.choice(side) for _ in range(r.randint(0, 2))]:
        out.append(part())
    opens, closes = r.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div id="content">', "</div>"), ('<div class="post-body">', "</div>"), ("<div>", "</div>"), ("<section>", "</section>")])
    out += [opens, f"<h1>{say(sentence(), True)}</h1>"]
    for _ in range(r.choice([1, 2, 4, 8, 14])):
        out.append(paragraph())
        if r.random() < 0.05:
            out.append(side[0]())
    out.append(closes)
    out += [r.choice(side)() for _ in range(r.randint(0, 2))]
    out.append(f"<footer>&copy; {say(word() + '.example', False)} &middot; {sentence()}</footer>" if r.random() < 0.6 else f'<div class="footer"><p>{say(sentence(), False)}</p><ul>{links(3)}</ul></div>')
    return "".join(out) + r.choice(["</body></html>", "", "</html>"]), marks


def training_set(pages: int = TRAIN_PAGES, seed: int = 5) -> tuple[Pages, np.ndarray]:
    """Nodes and labels; an element is content if most of the text in it is."""
    r, p, marks = random.Random(seed), Pages(), []
    for i in range(pages):
        html, m = labelled_page(r)
        before = len(p.text)
        p.read(html, i)
        if sum(t is not None for t in p.text[before:]) != len(m):
            raise AssertionError("a page has other text runs than its labels")
        marks += m
    parent, chars = np.array(p.parent), np.array(p.chars, float)
    good = np.zeros(len(parent))
    good[[i for i, t in enumerate(p.text) if t is not None]] = np.array(marks, float)
    good *= chars
    for i in range(len(parent) - 1, -1, -1):
        if parent[i] >= 0:
            good[parent[i]] += good[i]
            chars[parent[i]] += chars[i]
    return p, good > 0.5 * np.maximum(chars, 1)


def train(pages: int = TRAIN_PAGES, seed: int = 5) -> Model:
    """Ascends the penalised log-likelihood: observed less expected counts of features and edge states."""
    p, y = training_set(pages, seed)
    f, n = forest(p), len(y)
    x = f.x
    m = Model(np.zeros(WIDTH), np.zeros((EDGES, 2, 2)))
    s, child = y.astype(int), f.parent >= 0
    seen = np.zeros((EDGES, 2, 2))
    np.add.at(seen, (f.edge[child], s[f.parent[child]], s[child]), 1)
    first, second = [np.zeros(WIDTH), np.zeros_like(seen)], [np.zeros(WIDTH), np.zeros_like(seen)]
    for step in range(1, STEPS + 1):
        node, joint = messages(f, np.stack([np.zeros(n), x @ m.weights], 1), m.pair)
        expected = np.zeros_like(seen)
        np.add.at(expected, f.edge[child], _normal(joint[child]))
        grads = [x.T @ (s - _normal(node)[:, 1]) / n - 1e-4 * m.weights, (seen - expected) / n - 1e-4 * m.pair]
        for i, (value, g) in enumerate(zip((m.weights, m.pair), grads)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            value += 0.08 * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-7)
    return m


_trained: list[Model] = []


def model() -> Model:
    if not _trained:
        _trained.append(train())
    return _trained[0]


# ---- extraction


def extract(pages: list[str | None], m: Model, threshold: float = THRESHOLD) -> list[tuple[str | None, int, int, float | None]]:
    """(text, text runs, content runs, least certain marginal) of each page."""
    p = Pages()
    for i, html in enumerate(pages):
        if html:
            p.read(html, i)
    out: list[tuple[str | None, int, int, float | None]] = [(None if h is None else "", 0, 0, None) for h in pages]
    if not p.parent:
        return out
    prob = m.marginals(forest(p))
    kept: dict[int, list[str]] = {}
    stats: dict[int, list] = {}
    last: dict[int, int] = {}
    for i, text in enumerate(p.text):
        if text is None:
            continue
        page = p.page[i]
        st = stats.setdefault(page, [0, 0, 1.0])
        st[0] += 1
        st[2] = min(st[2], max(prob[i], 1 - prob[i]))
        if prob[i] >= threshold:
            st[1] += 1
            parts = kept.setdefault(page, [])
            if parts:
                parts.append(" " if last[page] == p.block[i] else "\n")
            parts.append(unescape(text))
            last[page] = p.block[i]
    for page, (runs, content, least) in stats.items():
        out[page] = ("".join(kept.get(page, [])), runs, content, round(float(least), 6))
    return out


def _extracted(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            lo, held = 0, 0
            for i in range(1, batch.num_rows + 1):
                held += size[i - 1]
                if i < batch.num_rows and held + size[i] <= BYTES:
                    continue
                part, lo, held = batch.slice(lo, i - lo), i, 0
                rows = extract(part.column(1).to_pylist(), m, threshold)
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["page_id", "text", "runs", "content_runs", "certainty"])

    return run


def extract_html(pages: DataFrame, threshold: float = THRESHOLD, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, runs, content_runs, certainty) for each page: its main text, blocks parted by line ends.

    runs counts the text runs outside scripts, styles and comments, content_runs those whose marginal reaches the
    threshold, certainty is the least max(p, 1 - p) of them.  A null page has null text; an empty one, or one without text,
    has empty text, 0 runs and null certainty.  Null ids and repeated rows are kept; an empty table gives an empty result;
    other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model())
    flat = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return flat.mapInArrow(_extracted(shared, threshold), "page_id bigint, text string, runs int, content_runs int, certainty double")
