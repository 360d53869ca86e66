"""Tokens with positions, stop words and the stemmer of keyword search."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

STOP_WORDS = tuple(sorted("""
i me my he him his she her it its we us our you your they them their this that these those a an the am is are was were be been being
do does did have has had can could will would shall should may might must not no nor and or but so if as than then once because just too very
at by for from in into of on out over under up down to with about after again before between further
here there when where why how all both each every few more most other some such only own same
""".split()))


def word_array(text: Column) -> Column:
    """ARRAY<STRING>: white-space parts, trimmed of signs at both ends, lower-cased; some may be empty.

    Signs beside white space go by one expression over the whole text, which is far cheaper than trimming each part.
    """
    even = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(" "))
    bare = F.regexp_replace(even, r"(?<= )[^\p{L}\p{N} ]+|[^\p{L}\p{N} ]+(?= )", "")
    return F.split(F.lower(F.substring(bare, F.lit(2), F.length(bare) - 2)), " ")


def words_with_positions(df: DataFrame, text: Column, *keep: Column | str) -> DataFrame:
    """(keep, pos, term): the words of `word_array`; empty ones leave a gap in pos."""
    return df.where(text.isNotNull()).select(*keep, F.posexplode(word_array(text)).alias("pos", "term")).where("term <> ''")


# ---- words of Arrow batches

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x9E3779B97F4A7C15
#: Bytes of texts that are cut into words together; a longer text comes alone.
BYTES = 1 << 20


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(1)
def _codes() -> np.ndarray:
    return np.random.RandomState(7).randint(0, 1 << 63, 256).astype(np.uint64)


def word_codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges."""
    up, down = _powers(1 << max(20, int(len(buf)).bit_length()))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_codes()[buf] * up[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def code_of(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(word_codes(b, np.array([0]), np.array([len(b)]))[0])


def cut_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The words of `word_array`, for rows lo:hi of a column at a time: lo, hi, bytes, starts, ends, row - lo and place of each.

    White-space parts, lower-cased and trimmed of what is neither letter nor number; empty parts leave a gap in the places.
    """
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    sizes = pc.binary_length(lower).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, n in enumerate([*sizes, BYTES + 1]):
        if i > lo and held + n > BYTES:
            yield lo, i, *_cut(lower.slice(lo, i - lo))
            lo, held = i, 0
        held += n


def _cut(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]] if offs[-1] > offs[0] else np.empty(0, np.uint8)
    offs = offs - offs[0]
    on = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True  # words end where texts do
    starts = np.flatnonzero(on & (edge[:-1] | np.append(True, ~on[:-1])))
    ends = np.flatnonzero(on & (edge[1:] | np.append(~on[1:], True))) + 1
    row = np.searchsorted(offs, starts, "right") - 1
    place = np.arange(len(starts)) - np.searchsorted(starts, offs)[row]
    kept = np.flatnonzero(_ALNUM[buf])
    a, b = np.searchsorted(kept, starts), np.searchsorted(kept, ends)
    full = b > a
    a, b, row, place = a[full], b[full], row[full], place[full]
    starts, ends = kept[a], kept[b - 1] + 1
    odd = np.flatnonzero((buf[starts] >= 128) | (buf[ends - 1] >= 128))
    if len(odd):  # at the ends of few words stand signs that aren't ASCII
        known: dict[bytes, tuple[int, int]] = {}
        keep = np.ones(len(starts), bool)
        for k in odd:
            word = buf[starts[k] : ends[k]].tobytes()
            if word not in known:
                known[word] = _trimmed(word)
            cut, left = known[word]
            starts[k], ends[k] = starts[k] + cut, starts[k] + cut + left
            keep[k] = left > 0
        starts, ends, row, place = starts[keep], ends[keep], row[keep], place[keep]
    return buf, starts, ends, row, place


def _trimmed(word: bytes) -> tuple[int, int]:
    """Bytes to leave out in front, and bytes that are left."""
    text = word.decode("utf-8", "replace")
    good = [i for i, c in enumerate(text) if unicodedata.category(c)[0] in "LN"]
    if not good:
        return 0, 0
    return len(text[: good[0]].encode()), len(text[good[0] : good[-1] + 1].encode())


# ---- stemmer

_V = "aeiou"


def _measure(s: str) -> int:
    """Vowel groups less one; y goes on with a group but begins none."""
    groups, inside = 0, False
    for c in s:
        if c in _V:
            groups += not inside
            inside = True
        elif not (c == "y" and inside):
            inside = False
    return max(0, groups - 1)


def _cvc(s: str) -> bool:
    c = lambda x: x not in _V and x != "y"
    return len(s) >= 3 and c(s[-3]) and not c(s[-2]) and c(s[-1]) and s[-1] not in "wxy"


_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()
_TWO, _THREE = ([tuple(x.split(":")) for x in s.split()] for s in (_STEP2, _STEP3))


def _swap(s: str, pairs: list[tuple[str, ...]]) -> str:
    for end, new in pairs:
        if s.endswith(end) and _measure(s[: -len(end)]) > 0:
            return s[: -len(end)] + new
    return s


def stem(word: str) -> str:
    """The engine's Porter variant."""
    s = word.lower()
    if len(s.encode()) <= 2:
        return s
    if s.endswith(("sses", "ies")):
        s = s[:-2]
    elif s.endswith("s") and not s.endswith("ss"):
        s = s[:-1]
    tidy = False
    if s.endswith("eed"):
        if _measure(s[:-3]) > 0:
            s, tidy = s[:-1], True
    else:
        for end in ("ed", "ing"):
            if s.endswith(end):
                if any(c in _V for c in s[: -len(end)]):
                    s, tidy = s[: -len(end)], True
                break
    if tidy:
        if s.endswith(("at", "bl", "iz")):
            s += "e"
        elif len(s) > 1 and s[-1] == s[-2] and s[-1] not in _V + "lsz":
            s = s[:-1]
        if _measure(s) == 1 and _cvc(s):
            s += "e"
    if s.endswith("y") and any(c in _V for c in s[:-1]):
        s = s[:-1] + "i"
    s = _swap(_swap(s, _TWO), _THREE)
    for end in _STEP4:
        if s.endswith(end) and _measure(s[: -len(end)]) > 1:
            s = s[: -len(end)]
            break
    else:
        if s.endswith(("sion", "tion")) and _measure(s[:-3]) > 1:
            s = s[:-3]
    if s.endswith("e"):
        m = _measure(s[:-1])
        if m > 1 or (m == 1 and not _cvc(s[:-1])):
            s = s[:-1]
    if s.endswith("ll") and _measure(s) > 1:
        s = s[:-1]
    return s


@lru_cache(1 << 20)
def cached_stem(word: str) -> str:
    return stem(word)


@F.pandas_udf(StringType())
def stem_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of a column; a worker keeps those of its latest million words."""
    for b in batches:
        yield b.map(cached_stem, na_action="ignore")
