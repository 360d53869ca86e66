"""Operator 4: license scan.  Winnowed fingerprints of license templates stand in an inverted index; a document's word
k-grams that hit it pick candidate places, and banded sequence alignment there reports the matched coverage and span.

Every k-gram of the document is looked up, not only winnowed ones.  A template of L words may have e = (1 - coverage) * L
words changed, dropped or put in between; each such edit spoils the few fingerprints that cover it, so a place has all the
others, on diagonals at most e apart.  Places with so many hits are aligned, others can't match: no place within e edits is
missed, and chance hits of frequent k-grams cost no alignment.  K and the window are chosen for each template so that at
least one hit is left, down to every single word of very short ones.  The index is as large as the templates are: fixed.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BYTE, keyed_text, mix, text_chunks, words
from .license_texts import TEMPLATES

COVERAGE = 0.8
#: Sizes of k-grams and of winnowing windows, the first that leaves a hit is taken.
SCHEMES = ((2, 2), (2, 1), (1, 1))
MATCH, MISMATCH, GAP = 2, -1, 1

_LEXICAL = np.zeros(256, bool)
_LEXICAL[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLDED = BYTE.copy()
_FOLDED[65:91] = BYTE[97:123]


def word_hashes(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode(), np.uint8)
    return words(b, np.array([0, len(b)]), _LEXICAL, _FOLDED)[0]


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    if len(h) < k:
        return np.empty(0, np.uint64)
    g = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        g = mix(g * np.uint64(31) + h[i : len(h) - k + 1 + i])
    return g


def winnow(g: np.ndarray, window: int) -> list[int]:
    """Places of the least hash of each window, the rightmost of equals; of all if there are fewer than a window."""
    if not len(g):
        return []
    keep = set()
    for i in range(max(1, len(g) - window + 1)):
        part = g[i : i + window]
        keep.add(i + len(part) - 1 - int(part[::-1].argmin()))
    return sorted(keep)


class Index:
    """Inverted index of the templates' winnowed fingerprints, by size of k-gram: sorted keys, and (template, place) of each."""

    def __init__(self, templates: Mapping[str, str], coverage: float):
        self.names = sorted(templates)
        self.words = [word_hashes(templates[n]) for n in self.names]
        self.edits = [int((1 - coverage) * len(w) + 1e-9) for w in self.words]
        self.need = np.ones(len(self.names), np.int64)
        posts: dict[int, list[tuple[int, int, int]]] = {}
        for t, w in enumerate(self.words):
            for k, window in SCHEMES:
                g = kgrams(w, k)
                at = winnow(g, window)
                spoiled = max((sum(x <= y < x + k for y in at) for x in at), default=0)  # by one edit, at most
                if len(at) - self.edits[t] * spoiled >= 1:
                    self.need[t] = len(at) - self.edits[t] * spoiled
                    break
            for p in at if len(w) else ():
                posts.setdefault(k, []).append((int(g[p]), t, p))
        self.keys, self.lo, self.hi, self.template, self.place = {}, {}, {}, {}, {}
        for k, rows in posts.items():
            rows.sort()
            key = np.array([r[0] for r in rows], np.uint64)
            self.keys[k] = np.unique(key)
            self.lo[k], self.hi[k] = np.searchsorted(key, self.keys[k]), np.searchsorted(key, self.keys[k], "right")
            self.template[k], self.place[k] = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, diagonal, place in the template) of all hits of a text's words."""
        found = []
        for k, keys in self.keys.items():
            g = kgrams(h, k)
            at = np.searchsorted(keys, g)
            at[at == len(keys)] = 0
            p = np.flatnonzero(keys[at] == g)
            n = self.hi[k][at[p]] - self.lo[k][at[p]]
            first = np.repeat(self.lo[k][at[p]], n)
            row = first + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
            found.append((self.template[k][row], np.repeat(p, n) - self.place[k][row], self.place[k][row]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def align(a: np.ndarray, b: np.ndarray, shift: int, band: int) -> tuple[int, int, int, int]:
    """Best local alignment of template a with text b inside |j - i - shift| <= band: (matches, score, first, last + 1 in b).

    A row at a time over the band; gaps along the row by a running maximum.
    """
    width = 2 * band + 1
    h = np.zeros((len(a) + 1, width + 1), np.int64)  # column c of row i stands for j = i + shift - band + c, words taken of b
    ramp = np.arange(width) * GAP
    for i in range(1, len(a) + 1):
        j = np.arange(width) + (i + shift - band)
        ok = (j >= 1) & (j <= len(b))
        same = np.zeros(width, bool)
        same[ok] = b[j[ok] - 1] == a[i - 1]
        row = np.maximum(h[i - 1, :width] + np.where(same, MATCH, MISMATCH), h[i - 1, 1:] - GAP)
        row = np.where(ok, np.maximum(row, 0), 0)
        row = np.maximum.accumulate(row + ramp) - ramp
        h[i, :width] = np.where(ok, row, 0)
    i, c = np.unravel_index(int(h[:, :width].argmax()), (len(a) + 1, width))
    score, last, matches = int(h[i, c]), int(i + shift - band + c), 0
    first = last
    while i > 0 and h[i, c] > 0:
        j = int(i + shift - band + c)
        same = 1 <= j <= len(b) and b[j - 1] == a[i - 1]
        if h[i, c] == h[i - 1, c] + (MATCH if same else MISMATCH):
            matches += int(same)
            if same:
                first = j - 1
            i -= 1
        elif h[i, c] == h[i - 1, c + 1] - GAP:
            i, c = i - 1, c + 1
        else:
            c -= 1
            if c < 0:
                break
    return matches, score, first, last


def scan(h: np.ndarray, index: Index, coverage: float) -> list[tuple[int, float, int, int, int]]:
    """(template, coverage, matches, first word, last word + 1) of the places in one text, best of those that overlap."""
    template, shift, place = index.hits(h)
    order = np.lexsort((shift, template))
    template, shift, place = template[order], shift[order], place[order]
    found = set()
    cuts = np.flatnonzero(np.append(True, template[1:] != template[:-1])) if len(template) else np.empty(0, np.int64)
    for lo, hi in zip(cuts, np.append(cuts[1:], len(template))):
        t, d = int(template[lo]), shift[lo:hi]
        a, edits = index.words[t], index.edits[t]
        upto = np.searchsorted(d, d + edits, "right")
        many = upto - np.arange(len(d)) >= index.need[t]
        behind, step = -np.inf, max(1, edits)
        diagonals, at = np.unique(d, return_index=True)
        for x, i in zip(diagonals[many[at]].tolist(), at[many[at]]):  # the least diagonal of a place's hits
            if x <= behind or len(np.unique(place[lo + i : lo + upto[i]])) < index.need[t]:
                continue
            behind = x + step  # one alignment for the places that begin up to there: its band holds theirs, edits to either side
            band = (step + 3 * edits + 1) // 2 + 1
            mid = x - edits + band
            first, last = max(0, mid - band), min(len(h), mid + len(a) + band)
            m, _, start, stop = align(a, h[first:last], mid - first, band)
            if m and m >= coverage * len(a) - 1e-9:
                found.add((t, m / len(a), m, first + start, first + stop))
    return best_of(found, index.names)


def best_of(found: set[tuple[int, float, int, int, int]], names: list[str]) -> list[tuple[int, float, int, int, int]]:
    """Of places that overlap by half of one that is worse, the better alone, in order."""
    out: list[tuple[int, float, int, int, int]] = []
    for x in sorted(found, key=lambda x: (-x[2], -x[1], x[3], names[x[0]])):
        if all(min(x[4], y[4]) - max(x[3], y[3]) <= 0.5 * (x[4] - x[3]) for y in out):
            out.append(x)
    return sorted(out, key=lambda x: (x[3], names[x[0]]))


def _scanned(shared, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            rows = []
            for lo, hi, buf, offs in text_chunks(batch, "text", lower=False):
                h, starts, ends, ptr = words(buf, offs, _LEXICAL, _FOLDED)
                touched = np.zeros(len(h), bool)
                for k, keys in index.keys.items():
                    g = kgrams(h, k)
                    at = np.searchsorted(keys, g)
                    at[at == len(keys)] = 0
                    touched[: len(g)] |= keys[at] == g
                chars = None
                for i in np.unique(np.searchsorted(ptr, np.flatnonzero(touched), "right") - 1):
                    a, b = ptr[i], ptr[i + 1]
                    for t, cov, m, first, last in scan(h[a:b], index, coverage):
                        if chars is None:
                            chars = np.append(0, np.cumsum((buf & 0xC0) != 0x80))  # characters before each byte
                        start, end = (int(chars[x] - chars[offs[i]]) for x in (starts[a + first], ends[a + last - 1]))
                        rows.append((batch.column(0)[lo + int(i)].as_py(), index.names[t], round(cov, 6), m, start, end))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "license", "coverage", "matched_words", "start", "end"])

    return run


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, coverage, matched_words, start, end): places where at least `coverage` of a template's words align.

    All are found that have at most (1 - coverage) of the template's words changed, dropped or put in between; others may be.
    start and end are character offsets in the text.  Of places that overlap by half the one with most matched words is
    reported (ties: higher coverage, earlier, first name), so a notice goes under the version that it names.  Null, empty and short texts match nothing; null ids are kept;
    repeated rows report each; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates, coverage))
    return keyed_text(docs, id_col, text_col).mapInArrow(_scanned(shared, coverage), "doc_id bigint, license string, coverage double, matched_words int, start int, end int")


def brute_force(text: str | None, templates: Mapping[str, str], coverage: float = COVERAGE) -> list[tuple[str, int]]:
    """(license, matched words) by aligning every template with the whole text, without index or band; for tests, of texts
    where no template stands twice."""
    h, names, found = word_hashes(text or ""), sorted(templates), set()
    for i, n in enumerate(names):
        a = word_hashes(templates[n])
        if len(h):
            m, _, first, last = align(a, h, 0, max(len(a), len(h)) + 1)
            if m and m >= coverage * len(a) - 1e-9:
                found.add((i, m / len(a), m, first, last))
    return [(names[x[0]], x[2]) for x in best_of(found, names)]
