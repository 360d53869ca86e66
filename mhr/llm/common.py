"""Shared plumbing: Arrow text buffers and vectorised word hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mhr.sources.shared import shared_dir, stored  # noqa: F401 - the operators take them from here

#: The SQL twin of `words`: split on it after lower(), and drop empty strings.
WORD_SPLIT = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
SEED = 20_240_117


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id BIGINT, text STRING); every other column, whatever its name, is left out."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def n_words(text: Column) -> Column:
    """Words parted by white space; 0 for null or blank text."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("bigint")


# ---- hashing

_M64 = (1 << 64) - 1


def _splitmix(seed: int, n: int) -> np.ndarray:
    out, x = np.empty(n, np.uint64), seed & _M64
    for i in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _M64
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M64
        out[i] = z ^ (z >> 31)
    return out


BYTE = _splitmix(SEED, 256)
BASE = int(_splitmix(SEED + 1, 1)[0]) | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 20, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, BASE, np.uint64), np.full(size, BASE_INV, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def lowered(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the lower-cased strings, and where each begins (null counts as empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.utf8_lower(pc.fill_null(col.cast(pa.large_string()), ""))
    return raw(col)


def plain(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As `lowered`, in the case as it is."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return raw(pc.fill_null(col.cast(pa.large_string()), ""))


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def words(buf: np.ndarray, offs: np.ndarray, member: np.ndarray = _WORD, table: np.ndarray = BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes (lower-case ASCII letters, digits, non-ASCII), never across texts.
    Returns hashes, starts, ends (byte positions) and ptr: words of text i are ptr[i]:ptr[i+1]."""
    n = len(buf)
    if not n:
        z = np.empty(0, np.int64)
        return np.empty(0, np.uint64), z, z, np.zeros(len(offs), np.int64)
    parts, lo = [], 0
    while lo < n:  # a piece at a time, cut where no word is, to bound memory in long texts
        hi = min(n, lo + PIECE)
        while hi < n and member[buf[hi - 1]] and member[buf[hi]]:
            rest = np.flatnonzero(~member[buf[hi : hi + PIECE]])
            hi = min(n, hi + (int(rest[0]) + 1 if len(rest) else PIECE))
        a, b = np.searchsorted(offs, (lo, hi), "left")
        h, starts, ends = _piece(buf[lo:hi], offs[a:b] - lo, member, table)
        parts.append((h, starts + lo, ends + lo))
        lo = hi
    h, starts, ends = (np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]
    return h, starts, ends, np.searchsorted(starts, offs)


#: Bytes that `words` looks at together.
PIECE = 1 << 20


def _piece(buf: np.ndarray, cuts: np.ndarray, member: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a piece, in which texts begin at `cuts`."""
    n = len(buf)
    on = member[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = on[:-1]
    inner = cuts[(cuts > 0) & (cuts < n)]
    before[inner] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = on[1:]
    after[inner - 1] = False
    starts, ends = np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1
    up, down = _power(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(table[buf] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends


def text_chunks(batch: pa.RecordBatch, name: str, limit: int = 1 << 20, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo:hi of a batch with their bytes (lower-cased or not), about `limit` bytes at a time; a longer text comes alone and whole."""
    encode = lowered if lower else plain
    col = batch.column(batch.schema.get_field_index(name))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), np.int64)
    lo, total = 0, 0
    for i, s in enumerate(sizes):
        if i > lo and total + s > limit:
            yield lo, i, *encode(col.slice(lo, i - lo))
            lo, total = i, 0
        total += s
    if lo < len(sizes):
        yield lo, len(sizes), *encode(col.slice(lo))


def hash_of(word: str) -> int:
    """The hash that `words` gives a single word."""
    buf = np.frombuffer(word.lower().encode(), np.uint8)
    return int(words(buf, np.array([0, len(buf)]))[0][0])


def split_words(text: str | None) -> list[str]:
    """Plain-Python twin of `words`, for brute-force versions."""
    return [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", (text or "").lower()) if w]
