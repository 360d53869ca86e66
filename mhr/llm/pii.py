"""Operator 6: personal data.  High-recall generators propose spans, which may overlap; gradient-boosted trees score each
by its format and context; Platt-calibrated thresholds by kind select those to redact.

The trees are trained here, on seeded synthetic sentences that hold personal data and look-alikes of it.  The generators
bound no length but that of what they name (a phone number has at most six groups of digits, an octet three digits, a
number a digit sequence of eight or more, a secret without a key word 14 characters or more); nothing of fewer than six
characters is proposed.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("EMAIL", "PHONE", "NUMBER", "IP", "SECRET")
ROUNDS, DEPTH, RATE, BINS = 60, 3, 0.2, 32
SAMPLES, RECALL = 6000, 0.998

_HINT = re.compile(r"[0-9@]|::")
_KEYED = re.compile(r"(?:pass(?:word|wd|phrase|code)|pwd|token|secret|api[_ -]?key|access[_ -]?key|credential|bearer)[\w-]*+[\"']?\s*+[:=]\s*+[\"']?([^\s\"'|,;<>]{6,})", re.I)
_PREFIXED = re.compile(r"(?<!\w)(?:Bearer |AKIA|ASIA|ghp_|gho_|sk-|xox[abp]-|AIza|eyJ)[\w\-]{12,}")
_EMAIL = re.compile(r"(?<![\w.+\-])[\w.+\-]++@[\w\-]++(?:\.[\w\-]++)*\.[^\W\d_]{2,}")
_IP = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)")
_IP6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*::|(?:[0-9A-Fa-f]{1,4}:){7})(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_PHONE = re.compile(r"(?<!\w)(?:\+|00)?\(?\d{1,4}\)?(?:[ .\-/]{0,2}\(?\d{2,5}\)?){1,5}(?!\w)")
_NUMBER = re.compile(r"(?<!\w)[A-Za-z]{0,2}\d(?:[ \-]?[A-Za-z]?\d){7,}(?!\w)")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+\d)[A-Za-z0-9+/_\-]{14,}+={0,2}(?!\w)")
_PHONE_PLAIN = re.compile(r"(?<![\w+])\+?\d{0,3}[ .\-]?(?:\(\d{2,4}\)|\d{3})[ .\-]\d{3,4}[ .\-]?\d{4}(?!\w)")
_NUMBER_PLAIN = re.compile(r"(?<!\w)\d{12,19}(?!\w)")
_GENERATORS = ((0, _EMAIL), (3, _IP), (3, _IP6), (1, _PHONE), (1, _PHONE_PLAIN), (2, _NUMBER), (2, _NUMBER_PLAIN), (4, _SECRET))
_CONTEXT = tuple(
    re.compile(x, re.I)
    for x in (r"pass\w*\W{0,5}$|(?:pwd|token|secret|\w*key|bearer|credential|auth)\W{0,5}$", r"\b(?:phone|tel|call|fax|mobile|cell)\W{0,5}$", r"\b(?:card|iban|account|ssn|visa|passport|credit)\W{0,5}$", r"\b(?:ip|host|server|address)\W{0,5}$", r"\b(?:version|release|v|chapter|section|page|isbn|order|build|commit|sha\d*|rev|doi|item|figure|table|model)\W{0,3}$")
)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all proposed spans, in order; they may overlap."""
    found = set()
    if _HINT.search(text):
        for kind, pattern in _GENERATORS:
            for m in pattern.finditer(text):
                found.add((m.start(), m.end(), kind))
    for m in _KEYED.finditer(text) if "=" in text or ":" in text else ():
        found.add((m.start(1), m.start(1) + len(m[1].rstrip(".!?)*%&$#")), 4))
    for m in _PREFIXED.finditer(text):
        found.add((m.start(), m.end(), 4))
    return sorted(x for x in found if x[1] - x[0] >= 6)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def features(text: str, start: int, end: int, kind: int) -> list[float]:
    s, left, right = text[start:end], text[max(0, start - 24) : start], text[end : end + 8]
    digits = re.sub(r"[^0-9]", "", s)
    groups = [len(x) for x in re.findall(r"\d+", s)]
    letters = sum(c.isalpha() for c in s)
    counts = Counter(s)
    entropy = -sum(n / len(s) * math.log2(n / len(s)) for n in counts.values())
    parts = s.split(".")
    octets = len(parts) == 4 and all(p.isdigit() and int(p) < 256 for p in parts)
    return [
        *(float(kind == k) for k in range(len(KINDS))), len(s), len(digits), letters, len(groups), len(digits) / len(s), float(s[0] == "+" or left[-1:] == "+"), float("(" in s),
        float(len(digits) >= 12 and _luhn(digits)), entropy, s.count("."), s.count("-"), s.count(" "), float(octets), *(float(bool(p.search(left))) for p in _CONTEXT), float(left[-1:] in "\"'=" and left != ""),
        float(bool(re.match(r"[%$€°]|\s?(?:km|kg|eur|usd|am|pm)\b", right, re.I))), float(bool(re.fullmatch(r"[0-9a-fA-F]+", s))), float(any(c.isupper() for c in s) and letters and not any(c.islower() for c in s)),
        float(bool(re.match(r"(?:19|20)\d\d\b", s))), float(groups[0] if groups else 0), float(groups[-1] if groups else 0), float(sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:]))), float("@" in s),
    ]


# ---- training sentences

_VOWEL, _CONSONANT = "aeiou", "bcdfghklmnprstvz"


def _word(r: random.Random) -> str:
    w = "".join(r.choice(_CONSONANT) + r.choice(_VOWEL) for _ in range(r.randint(1, 4)))
    return w + r.choice(["", "", "n", "é", "ng", "."])


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _of(r: random.Random, chars: str, n: int) -> str:
    return "".join(r.choice(chars) for _ in range(n))


_HEX, _ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _private(r: random.Random) -> tuple[str, str, str]:
    """(before, value, after)"""
    d = lambda n: _digits(r, n)
    kind = r.randrange(5)
    if kind == 0:
        return "", f"{_word(r).strip('.')}{r.choice(['', '.', '_'])}{r.choice(['', d(2), _word(r).strip('.')])}@{r.choice(['mail' + d(1) + '.', ''])}{_word(r).strip('.é')}.{r.choice(['com', 'org', 'net', 'de', 'co.uk', 'io'])}", ""
    if kind == 1:
        form = r.choice([f"+{r.choice('1234')} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+{r.randint(10, 99)} {d(3)} {d(7)}", f"+{r.randint(10, 99)} {d(2)} {d(4)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"+1{d(10)}"])
        return r.choice(["", "", "tel: ", "call ", "phone "]), form, ""
    if kind == 2:
        form = r.choice([d(16), d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", d(15), f"{d(3)}-{d(2)}-{d(4)}", f"DE{d(20)}", f"{_of(r, 'ABDEFGNS', 2)}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}"])
        return r.choice(["", "", "card ", "ssn ", "account "]), form, ""
    if kind == 3:
        six = [_of(r, _HEX, r.randint(1, 4)) for _ in range(8)]
        short = ":".join(six[: r.randint(1, 3)]) + "::" + ":".join(six[6 : r.randint(7, 8)])
        return r.choice(["", "", "ip ", "host ", "from "]), ".".join(str(r.randint(1, 255)) for _ in range(4)) if r.random() < 0.8 else r.choice([":".join(six), "2001:db8" + short[4:] if len(short) > 8 else short + "::1"]), ""
    form, key = r.randrange(4), r.choice(["token", "password", "secret", "api_key", "API_KEY", "Password", "access_key"])
    if form == 0:
        return "", "AKIA" + _of(r, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), ""
    value = r.choice([_of(r, _HEX, r.choice([18, 32, 40])), _of(r, _ALNUM, r.randint(10, 40)), _of(r, _ALNUM[:52], r.randint(15, 70)) + d(3) + _of(r, _ALNUM, 9), "sk-" + _of(r, _ALNUM, 32), "ghp_" + _of(r, _ALNUM, 36), _word(r).strip(".") + d(3) + "!x"])
    return (f'{key} = "', value, '"') if form == 1 else (f"{key}={r.choice(['', ''])}", value, "") if form == 2 else (f"{key}: ", value, "")


def _harmless(r: random.Random) -> tuple[str, str, str]:
    d, n = lambda k: _digits(r, k), r.randint
    return "", r.choice([
        f"{n(1900, 2030)}-{n(10, 12)}-{n(10, 28)}", f"{n(10, 28)}.{n(10, 12)}.{n(1950, 2030)}", f"{n(10, 23)}:{n(10, 59)}:{n(10, 59)}", f"version {n(1, 20)}.{n(0, 20)}.{n(0, 90)}", f"v{n(1, 9)}.{n(0, 20)}.{n(0, 9)}.{n(0, 900)}", f"Version {n(1, 9)}.{n(0, 9)}.",
        f"{n(100, 999)}-{n(100, 999)}", f"{n(1, 999)} {n(100, 999)} {n(100, 999)}", f"{n(1, 999)},{n(100, 999)},{n(100, 999)}", f"{n(1000, 99999)} km", f"{n(1000, 9999)}.{d(2)} EUR", f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"page {n(10, 999)}-{n(10, 999)}",
        f"order {d(7)}", f"#{d(6)}", f"{n(1900, 2000)}-{n(2000, 2030)}", f"{n(1900, 2000)}/{n(10, 99)}", f"commit {_of(r, _HEX, 40)}", f"sha256 {_of(r, _HEX, 64)}", f"{_word(r)}{d(2)}", f"@{_word(r)}", f"{d(2)}%", f"{n(1, 99)}.{d(6)}", f"section {n(1, 9)}.{n(1, 9)}.{n(1, 9)}.{n(1, 9)}",
        f"doi 10.{d(4)}/{d(8)}", f"{_word(r)}-{_word(r)}-{n(1, 9)}-{_word(r)}".replace(".", ""), f"{n(10, 99)} {n(1000, 9999)} {_word(r)}", f"token {_word(r)}{_word(r)}{_word(r)}".replace(".", ""), f"secret {_word(r)}{_word(r)}{_word(r)}", f"password {_word(r)}{_word(r)}{_word(r)}", f"https://{_word(r).strip('.')}.com/{_word(r).strip('.')}/{d(6)}", f"{n(1, 40)} {n(10, 12)} {n(1900, 2030)}", " ".join(str(n(1, 99)) for _ in range(n(8, 60))), f"{n(1, 9)} {n(10, 99)} {n(1, 9)} {n(10, 99)} {n(1, 9)} {n(10, 99)} {n(100, 999)}",
    ]), ""


def sentences(count: int = SAMPLES, seed: int = 11) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Synthetic (text, private spans): of three, one holds personal data, one a look-alike, one either in a louder style."""
    r = random.Random(seed)
    for i in range(count):
        private = r.random() < 0.5
        before, value, after = (_private if private else _harmless)(r)
        lead, tail = " ".join(_word(r) for _ in range(r.randint(0, 6))), " ".join(_word(r) for _ in range(r.randint(0, 6)))
        if i % 3 == 2:
            style = r.randrange(4)
            if style == 0:
                before, value, lead, tail = before.upper(), value.upper(), lead.upper(), tail.upper()
            after += ["!!", "%%%", "###", " |"][style]
        lead += r.choice([" ", " ", "\n", ", "]) if lead else ""
        text = f"{lead}{before}{value}{after}{r.choice([' ', '. ', ', ', chr(10)])}{tail}"
        at = len(lead) + len(before)
        yield text, [(at, at + len(value))] if private else []


# ---- boosted trees


@dataclass
class Trees:
    feature: np.ndarray  # (rounds, 2^depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # (rounds, 2^depth)
    base: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    threshold: list[float] = field(default_factory=lambda: [0.5] * len(KINDS))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (2**DEPTH - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of the log loss, on quantile bins."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    inner, base = 2**DEPTH - 1, float(np.log(y.mean() / (1 - y.mean())))
    t = Trees(np.zeros((ROUNDS, inner), np.int64), np.full((ROUNDS, inner), np.inf), np.zeros((ROUNDS, inner + 1)), base)
    score = np.full(len(y), base)
    for k in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h, at = y - p, p * (1 - p) + 1e-6, np.zeros(len(y), np.int64)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            best = (1e-3, 0, np.inf, len(cuts[0]))
            if len(mine) > 10:
                total_g, total_h = g[mine].sum(), h[mine].sum()
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[mine, j]
                    lg, lh = np.cumsum(np.bincount(b, g[mine], len(c) + 1))[:-1], np.cumsum(np.bincount(b, h[mine], len(c) + 1))[:-1]
                    gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], j, c[i], i)
            t.feature[k, node], t.cut[k, node] = best[1], best[2]
            at[mine] = 2 * node + 1 + (x[mine, best[1]] > best[2])
        leaf = at - inner
        t.leaf[k] = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        score += t.leaf[k][leaf]
    return t


def train(seed: int = 11) -> Trees:
    """Boost on four fifths of the sentences; the rest gives the calibration and each kind's threshold."""
    x, y, held, kinds = [], [], [], []
    for i, (text, spans) in enumerate(sentences(seed=seed)):
        for s, e, k in candidates(text):
            x.append(features(text, s, e, k))
            y.append(float(any(s < b and e > a and (e - s) >= 0.6 * (b - a) for a, b in spans)))
            held.append(i % 5 == 0)
            kinds.append(k)
    x, y, held, kinds = np.array(x), np.array(y), np.array(held), np.array(kinds)
    t = boost(x[~held], y[~held])
    z, truth = t.raw(x[held]), y[held]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of Platt scaling
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - truth) * z).sum() + 1e-3 * (a - 1), (p - truth).sum()])
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    t.slope, t.shift = float(a), float(b)
    p = t.probability(x[held])
    for k in range(len(KINDS)):
        mine = p[(kinds[held] == k) & (truth > 0)]
        if len(mine):
            t.threshold[k] = float(np.clip(np.quantile(mine, 1 - RECALL), 0.1, 0.5))
    return t


_trained: dict[int, Trees] = {}


def model(seed: int = 11) -> Trees:
    if seed not in _trained:
        _trained[seed] = train(seed)
    return _trained[seed]


# ---- redaction


def spans_of(text: str, t: Trees) -> list[tuple[int, int, str, float]]:
    """Chosen spans, best first where they overlap (by score, then length, then place), returned in order."""
    found = candidates(text)
    if not found:
        return []
    p = t.probability(np.array([features(text, *c) for c in found]))
    ranked = sorted((-round(float(q), 6), s - e, s, k) for (s, e, k), q in zip(found, p) if q >= t.threshold[k])
    taken: list[tuple[int, int, str, float]] = []  # apart, in order
    for q, neg, s, k in ranked:
        e = s - neg
        i = bisect_left(taken, s, key=lambda x: x[1] - 1)  # the first that ends behind s
        j = i
        while j < len(taken) and taken[j][0] < e:
            j += 1
        if i == j:
            taken.insert(i, (s, e, KINDS[k], -q))
        else:  # what is left of a chosen span's overlap goes too, under the best of those that it touches
            best = max(taken[i:j], key=lambda x: x[3])
            taken[i:j] = [(min(s, taken[i][0]), max(e, taken[j - 1][1]), best[2], best[3])]
    return taken


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    out, at = [], 0
    for s, e, kind, _ in spans:
        out += [text[at:s], f"[{kind}]"]
        at = e
    return "".join(out) + text[at:]


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())])


def _redacted(shared, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            spans = [spans_of(x, t) if x else [] for x in texts]
            new = pa.array([redact(x, s) if s else x for x, s in zip(texts, spans)], pa.string())
            extra = [pa.array([[dict(zip(("start", "end", "kind", "score"), s)) for s in x] for x in spans], pa.list_(_SPAN))] if with_spans else []
            yield pa.RecordBatch.from_arrays([new, *extra, *batch.columns[1:]], ["text", *["spans"] * with_spans, *batch.schema.names[1:]])

    return run


def redact_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans) for each row: the text with each chosen span replaced by [KIND], and the spans (character
    offsets in the old text, kind, calibrated probability).

    A null text stays null, an empty one empty, both with no spans; null ids and repeated rows are kept as they are; an
    empty table gives an empty result; other columns are ignored.  Equal scores prefer the longer, then the earlier span.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model())
    flat = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("bigint").alias("doc_id"))
    out = flat.mapInArrow(_redacted(shared, True), "text string, spans array<struct<start:int,end:int,kind:string,score:double>>, doc_id bigint")
    return out.select("doc_id", "text", "spans")


def redact_column(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs`, with the text column redacted; one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model())
    tmp = [f"_c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    rest = [c for i, c in enumerate(tmp) if i != at]
    flat = docs.toDF(*tmp)
    kinds = ", ".join(f"{c} {t}" for c, t in flat.dtypes if c != tmp[at])
    out = flat.select(F.col(tmp[at]).cast("string").alias("text"), *rest).mapInArrow(_redacted(shared, False), f"text string{', ' * bool(kinds)}{kinds}")
    return out.select(*[F.col("text") if i == at else F.col(c) for i, c in enumerate(tmp)]).toDF(*docs.columns)
