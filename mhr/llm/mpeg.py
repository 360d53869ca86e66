"""Operator 9: MPEG audio columns.  Resynchronises frame headers, parses tags and variable-bitrate tables, verifies
checksums, and stores exact durations and the byte offset of every frame.

`encode` writes streams that stand in for a media table: by their seed in all layers, versions, modes, tables and tags, of free
format too, damage included.  Their frame bodies carry every byte of a text, masked so that false syncs occur, as many
frames as that takes; `decode` gives the text back.
"""

from __future__ import annotations

import random
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text

_V1 = {1: (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), 2: (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), 3: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)}
_V2 = {1: (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), 2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), 3: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    bitrate: int
    rate: int
    length: int
    samples: int
    side: int
    mono: bool
    padding: int

    @property
    def kind(self) -> tuple:
        return self.version, self.layer, self.rate, self.bitrate == 0


def _header(b1: int, b2: int, b3: int) -> Header | None:
    """Header of the three bytes after 0xFF; None if reserved.  Of free format bitrate is 0, and length is left to `frame_at`."""
    v, layer, rate, index = (b1 >> 3) & 3, 4 - ((b1 >> 1) & 3), (b2 >> 2) & 3, b2 >> 4
    if b1 & 0xE0 != 0xE0 or v == 1 or layer == 4 or rate == 3 or index == 15 or b3 & 3 == 2:
        return None
    kbps, hz, pad, mono = (_V1 if v == 3 else _V2)[layer][index - 1] if index else 0, _RATES[v][rate], (b2 >> 1) & 1, b3 >> 6 == 3
    samples = 384 if layer == 1 else 1152 if layer == 2 or v == 3 else 576
    length = (12_000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    side = 0 if layer != 3 else (17 if mono else 32) if v == 3 else (9 if mono else 17)
    return Header({3: "1", 2: "2", 0: "2.5"}[v], layer, not b1 & 1, kbps, hz, length, samples, side, mono, pad * (4 if layer == 1 else 1))


_HEADERS: dict[int, Header | None] = {}


def header_at(data: bytes, at: int) -> Header | None:
    if at + 4 > len(data) or data[at] != 0xFF:
        return None
    key = data[at + 1] << 16 | data[at + 2] << 8 | data[at + 3] & 0xC3
    if key not in _HEADERS:
        _HEADERS[key] = _header(data[at + 1], data[at + 2], data[at + 3] & 0xC3)
    return _HEADERS[key]


def _table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ (0x8005 if c & 0x8000 else 0)
        out.append(c & 0xFFFF)
    return out


_CRC = _table()


def crc16(data: bytes, value: int = 0xFFFF) -> int:
    for x in data:
        value = (value << 8) & 0xFFFF ^ _CRC[(value >> 8) ^ x]
    return value


def _bit_crc(data: bytes, bits: int, value: int) -> int:
    value = crc16(data[: bits // 8], value)
    for i in range(bits % 8):
        top = (value >> 15) ^ (data[bits // 8] >> (7 - i) & 1)
        value = (value << 1) & 0xFFFF ^ (0x8005 if top else 0)
    return value


#: Frames of free format are shorter than the longest of the tables, 2,880 bytes.
FREE = 4096


def free_length(data: bytes, at: int, h: Header, end: int) -> int | None:
    """Unpadded length of free-format frames, from a frame at `at`: the least at which two more headers of its kind follow, or
    one and the end."""
    q = at + 4
    while (q := data.find(b"\xff", q, min(end, at + FREE))) >= 0:
        g = header_at(data, q)
        if g and g.kind == h.kind:
            base = q - at - h.padding
            third = q + base + g.padding
            more = header_at(data, third)
            if third == end or more and more.kind == h.kind:
                return base
        q += 1
    return None


#: Bits of allocation of each subband in layer II, by table: high and low rates of MPEG 1, and MPEG 2.
_BITS = {"high": [4] * 11 + [3] * 12 + [2] * 7, "low": [4] * 2 + [3] * 10, "2": [4] * 4 + [3] * 7 + [2] * 19}


def _layer2_bands(h: Header) -> list[int]:
    if h.version != "1":
        return _BITS["2"]
    each = (h.bitrate or 384) // (1 if h.mono else 2)
    if each < 56:
        return _BITS["low"][: 12 if h.rate == 32000 else 8]
    return _BITS["high"][: 30 if each >= 96 and h.rate != 48000 else 27]


def checked_bits(h: Header, mode: int, body: bytes) -> int:
    """Bits of a frame's body that its checksum covers: side information in layer III, allocation in I, and scale factor selection in II."""
    if h.layer == 3:
        return 8 * h.side
    bound = 4 * ((mode & 3) + 1) if mode >> 2 == 1 else 32
    if h.layer == 1:
        return 4 * 32 if h.mono else 4 * (bound + 32)
    bits, at, used = int.from_bytes(body[:64].ljust(64, b"\0")), 0, 0
    for band, n in enumerate(_layer2_bands(h)):
        for _ in range(2 if not h.mono and band < bound else 1):
            at += n
            if bits >> (512 - at) & ((1 << n) - 1):
                used += 1 if h.mono or band < bound else 2  # one allocation for both channels
    return at + 2 * used


def checksum(head: bytes, h: Header, body: bytes) -> int:
    """Of the frame with the four bytes `head`."""
    bits = checked_bits(h, head[3] >> 4, body)
    return _bit_crc(body[: (bits + 7) // 8], bits, crc16(head[2:4]))


def check_frame(data: bytes, at: int, h: Header) -> bool | None:
    """Whether the checksum holds; None where the frame has none."""
    if not h.protected:
        return None
    return checksum(data[at : at + 4], h, data[at + 6 : at + min(h.length, 72)]) == int.from_bytes(data[at + 4 : at + 6])


@dataclass
class Audio:
    version: str | None = None
    layer: int | None = None
    sample_rate: int | None = None
    channels: int | None = None
    frames: int = 0
    samples: int = 0
    duration_us: int | None = None
    vbr: bool = False
    table: str | None = None
    declared_frames: int | None = None
    toc: list[int] = field(default_factory=list)
    title: str | None = None
    artist: str | None = None
    skipped_bytes: int = 0
    truncated: bool = False
    crc_ok: int = 0
    crc_bad: int = 0
    seek: list[int] = field(default_factory=list)


def _id3v2(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """Bytes that a tag at `at` takes (0: none), and its text frames."""
    if data[at : at + 3] != b"ID3" or at + 10 > len(data) or any(x & 0x80 for x in data[at + 6 : at + 10]):
        return 0, {}
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    major, flags, size = data[at + 3], data[at + 5], safe(data[at + 6 : at + 10])
    body, p, out = data[at + 10 : at + 10 + size], 0, {}
    if flags & 0x40 and len(body) >= 4:
        p = safe(body) if major == 4 else 4 + int.from_bytes(body[:4])
    while major in (3, 4) and p + 10 <= len(body) and body[p]:
        n = safe(body[p + 4 : p + 8]) if major == 4 else int.from_bytes(body[p + 4 : p + 8])
        name, value = body[p : p + 4].decode("latin-1"), body[p + 10 : p + 10 + n]
        if name[0] == "T" and value:
            coding = ("latin-1", "utf-16", "utf-16-be", "utf-8")[min(value[0], 3)]
            out[name] = value[1:].decode(coding, "replace").rstrip("\0")
        p += 10 + n
    return 10 + size + (10 if flags & 0x10 else 0), out


def _vbr_table(data: bytes, at: int, h: Header, out: Audio) -> int | None:
    """Reads a Xing, Info or VBRI table in the frame at `at`; returns samples to trim, or None if there is no table."""
    p, end = at + 4 + 2 * h.protected + h.side, at + h.length
    mark = data[p : p + 4]
    if mark in (b"Xing", b"Info"):
        flags, p, trim = int.from_bytes(data[p + 4 : p + 8]), p + 8, 0
        out.table, out.vbr = mark.decode(), mark == b"Xing"
        if flags & 1:
            out.declared_frames, p = int.from_bytes(data[p : p + 4]), p + 4
        p += 4 * (flags >> 1 & 1)
        if flags & 4:
            out.toc, p = list(data[p : min(p + 100, end)]), p + 100
        p += 4 * (flags >> 3 & 1)
        if data[p : p + 4] in (b"LAME", b"Lavc", b"Lavf") and p + 24 <= end:
            x = int.from_bytes(data[p + 21 : p + 24])
            trim = (x >> 12) + (x & 0xFFF)
        return trim
    p = at + 36
    if data[p : p + 4] == b"VBRI" and p + 26 <= end:
        out.table, out.vbr = "VBRI", True
        out.declared_frames = int.from_bytes(data[p + 14 : p + 18])
        entries, scale, size = struct.unpack(">HHH", data[p + 18 : p + 24])
        if 1 <= size <= 4:
            out.toc = [scale * int.from_bytes(data[q : q + size]) for q in range(p + 26, min(p + 26 + entries * size, end - size + 1), size)]
        return 0
    return None


def parse(data: bytes | None) -> Audio:
    """All of one stream.  A frame counts if it is whole and stands right after another, or if a header of the same kind, a tag
    or the end follows it; else the next sync word is sought, byte by byte.  A header that reaches beyond the end is the cut
    last frame only if no frame is found behind it."""
    out = Audio()
    data = data or b""
    at, end, tags, trim, rates = 0, len(data), {}, 0, set()
    while (n := _id3v2(data, at))[0]:
        tags, at = n[1] | tags, min(at + n[0], end)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        old = lambda a, b: data[end + a : end + b].split(b"\0")[0].decode("latin-1").rstrip()
        tags = {k: v for k, v in (("TIT2", old(3, 33)), ("TPE1", old(33, 63))) if v} | tags
    if end - at >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size = int.from_bytes(data[end - 20 : end - 16], "little") + 32 * (data[end - 9] >> 7)
        end = max(at, end - size)
    out.title, out.artist = tags.get("TIT2"), tags.get("TPE1")
    same, first, chain, cut, free = None, True, -1, False, {}

    def frame_at(p: int) -> Header | None:
        h = header_at(data, p)
        if h is None or h.bitrate:
            return h
        base = free.get(h.kind) or free_length(data, p, h, end)
        if base is not None and h.kind == same:
            free[h.kind] = base
        return None if base is None else replace(h, length=base + h.padding)

    while at < end:
        h = frame_at(at)
        after = at + h.length if h else 0
        if h and after <= end and (same is None or h.kind == same):
            follow = header_at(data, after)
            good = after == end or at == chain or (follow is not None and follow.kind == h.kind)
            if good:
                if same is None:
                    same = h.kind
                    if not h.bitrate:
                        free[same] = h.length - h.padding
                    out.version, out.layer, out.sample_rate, out.channels = h.version, h.layer, h.rate, 1 if h.mono else 2
                ok = check_frame(data, at, h)
                out.crc_ok, out.crc_bad = out.crc_ok + (ok is True), out.crc_bad + (ok is False)
                gone = _vbr_table(data, at, h, out) if first else None
                first = False
                if gone is not None:
                    trim = gone
                else:
                    out.frames, out.samples = out.frames + 1, out.samples + h.samples
                    out.seek.append(at)
                    rates.add(h.bitrate)
                at, chain, cut = after, after, False
                continue
        cut |= h is not None and after > end and same == h.kind
        nxt = data.find(b"\xff", at + 1, end)
        nxt = end if nxt < 0 else nxt
        out.skipped_bytes, at = out.skipped_bytes + nxt - at, nxt
    out.truncated = cut
    out.samples = max(0, out.samples - trim)
    out.vbr = out.vbr or len(rates) > 1
    if out.sample_rate:
        out.duration_us = (out.samples * 1_000_000 + out.sample_rate // 2) // out.sample_rate
    return out


# ---- streams from a seed


@dataclass(frozen=True)
class Kind:
    """What `encode` makes of a seed."""

    version: str
    layer: int
    mono: bool
    protected: bool
    rate_index: int
    table: str | None
    tags: str
    vbr: bool
    stray: bool
    bad: bool
    cut: bool
    free: bool

    @classmethod
    def of(cls, seed: int) -> Kind:
        digits, rest = [], seed
        for base in (3, 4, 2, 4, 2, 6, 3, 2):
            rest, d = divmod(rest, base)
            digits.append(d)
        version, layer, mono, table, protected, tags, rate, vbr = digits
        layer = (3, 3, 2, 1)[layer]
        return cls(
            ("1", "2", "2.5")[version], layer, mono == 1, protected == 1, rate, (None, "Xing", "Info", "VBRI")[table] if layer == 3 else None, ("", "ID3v2.3", "ID3v2.4", "ID3v1", "APE", "ID3v2.4 APE ID3v1")[tags], vbr == 1 and seed % 13 > 0,
            seed % 7 == 0, protected == 1 and seed % 5 == 0, seed % 11 == 0, seed % 13 == 0,
        )


def _masked(seed: int, payload: bytes) -> bytes:
    """The payload under a seeded mask, its own inverse: bodies hold every byte value, 0xFF and false syncs among them."""
    n = len(payload)
    return (int.from_bytes(payload) ^ int.from_bytes(random.Random(seed).randbytes(n + -n % 4)[:n])).to_bytes(n)  # by whole words: a longer mask begins alike


def _table_bytes(k: Kind, frames: int, side: int, size: int) -> bytes:
    if k.table == "VBRI":
        return bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, size, frames, 20, 3, 2, 1) + b"".join((i + 1).to_bytes(2) for i in range(20))
    seek = bytes(i * 255 // 99 for i in range(100))
    lame = b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1000).to_bytes(3) if k.table == "Info" else b""
    return bytes(side) + k.table.encode() + (7).to_bytes(4) + frames.to_bytes(4) + size.to_bytes(4) + seek + lame


def encode(seed: int, payload: bytes) -> bytes:
    """A stream of the seed's `Kind` whose frame bodies carry every byte of `payload`, masked, behind its length in 8 bytes:
    as many frames as that takes.

    The first frame holds the table, or silence; the last one's rest is zeros.  At least eight frames.  Before frame 5 a false
    sync may stand, frame 3 may have a wrong checksum, and a last frame that carries nothing may be cut short.
    """
    k, left, frames, at = Kind.of(seed), _masked(seed, len(payload).to_bytes(8) + payload), [], 0
    bits = {"1": 3, "2": 2, "2.5": 0}[k.version]
    while len(frames) < 8 or at < len(left):
        i = len(frames)
        index = 0 if k.free else 12 if i == 0 else 5 + (i % 3 if k.vbr else 0)
        b = bytes([0xFF, 0xE0 | bits << 3 | (4 - k.layer) << 1 | (not k.protected), index << 4 | k.rate_index << 2 | (i % 2) << 1, (3 if k.mono else 0) << 6])
        h = header_at(b, 0)
        if k.free:
            h = replace(h, length=FREE_BASE + h.padding)
        body = bytearray(h.length - 4 - 2 * k.protected)
        if i:
            part = left[at : at + len(body)]
            body[: len(part)] = part
            at += len(part)
        frames.append((b, h, body))
    if k.cut:
        b, h, body = frames[-1]
        frames.append((b, h, bytearray(len(body))))
    if k.table:
        b, h, body = frames[0]
        table = _table_bytes(k, len(frames) - 1, h.side, sum(len(f[2]) for f in frames))
        skip = 2 * k.protected if k.table == "VBRI" else 0  # VBRI stands 32 bytes after the header, checksum or not
        body[: len(table) - skip] = table[skip:]
    out, title = bytearray(), f"doc {seed}"
    if "ID3v2" in k.tags:
        major, text = int(k.tags[6]), b"\x03" + title.encode()
        tag = b"TIT2" + len(text).to_bytes(4) + b"\0\0" + text
        out += b"ID3" + bytes([major, 0, 0, 0, 0, len(tag) >> 7, len(tag) & 0x7F]) + tag
    for i, (b, h, body) in enumerate(frames):
        f = b + bytes(body)
        if k.protected:
            f = b + (checksum(b, h, bytes(body)) ^ (k.bad and i == 3)).to_bytes(2) + bytes(body)
        if i == 5 and k.stray:
            out += b"\0" + b[:3]
        out += f[: len(f) // 2] if k.cut and i == len(frames) - 1 else f
    if "APE" in k.tags:
        item = len(title).to_bytes(4, "little") + bytes(4) + b"Title\0" + title.encode()
        foot = b"APETAGEX" + struct.pack("<III", 2000, len(item) + 32, 1)
        out += foot + b"\0\0\0\xa0" + bytes(8) + item + foot + b"\0\0\0\x80" + bytes(8)
    if "ID3v1" in k.tags:
        out += b"TAG" + title.encode().ljust(30, b"\0") + bytes(95)
    return bytes(out)


#: Length of the unpadded frames that `encode` writes in free format.
FREE_BASE = 420


def decode(seed: int, data: bytes, audio: Audio) -> bytes | None:
    """The payload of `encode`, from the bodies of the frames that `parse` found; None if they don't hold it."""
    bodies, k = [], Kind.of(seed)
    for p in audio.seek if k.table else audio.seek[1:]:
        h = header_at(data, p)
        bodies.append(data[p + 4 + 2 * h.protected : p + (FREE_BASE + h.padding if k.free else h.length)])
    whole = _masked(seed, b"".join(bodies))
    n = int.from_bytes(whole[:8])
    return whole[8 : 8 + n] if n + 8 <= len(whole) else None


def synthetic_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media BINARY): a stream for each document with an id (0 or more) that carries its whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, part in _parts(b):
                media = [encode(i, (t or "").encode()) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return keyed_text(docs, id_col, text_col).where("doc_id >= 0").mapInArrow(run, "doc_id bigint, media binary")


def _parts(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of a batch, about `most` bytes of its second column at a time."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    lo, held = 0, 0
    for i, n in enumerate(size):
        if i > lo and held + n > most:
            yield lo, batch.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if lo < len(size):
        yield lo, batch.slice(lo)


_FIELDS = {"version": pa.string(), "layer": pa.int32(), "sample_rate": pa.int32(), "channels": pa.int32(), "frames": pa.int64(), "samples": pa.int64(), "duration_us": pa.int64(), "vbr": pa.bool_(), "table": pa.string(), "declared_frames": pa.int64(), "toc": pa.list_(pa.int64()), "title": pa.string(), "artist": pa.string(), "skipped_bytes": pa.int64(), "truncated": pa.bool_(), "crc_ok": pa.int64(), "crc_bad": pa.int64(), "seek": pa.list_(pa.int64())}
SCHEMA = "doc_id bigint, version string, layer int, sample_rate int, channels int, frames bigint, samples bigint, duration_us bigint, vbr boolean, table string, declared_frames bigint, toc array<bigint>, title string, artist string, skipped_bytes bigint, truncated boolean, crc_ok bigint, crc_bad bigint, seek array<bigint>"


def _parsed(payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, b in _parts(batch):
                data = [x.as_buffer().to_pybytes() if x.is_valid else None for x in b.column(1)]
                found = [parse(x) for x in data]
                more = [pa.array([decode(i, x, a) for i, x, a in zip(b.column(0).to_pylist(), data, found)], pa.binary())] if payload else []
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([getattr(a, f) for a in found], k) for f, k in _FIELDS.items()), *more], ["doc_id", *_FIELDS, *["payload"] * payload])

    return run


def mpeg_columns(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", payload: bool = False) -> DataFrame:
    """One row of audio columns for each row: format, exact samples and duration, table, tags, checksums and seek offsets.

    seek holds the byte offset of every audio frame (not that of a table's frame); skipped_bytes what resynchronising
    passed over; duration_us is exact to rounding, gapless trims taken off.  A stream without frames, an empty or null one
    has 0 frames and null format and duration.  Null ids and repeated rows are kept; an empty table gives an empty result;
    other columns are ignored.  With `payload` also what `decode` reads out of streams that `encode` made of their ids.
    """
    flat = media.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(media_col).cast("binary").alias("media"))
    return flat.mapInArrow(_parsed(payload), SCHEMA + ", payload binary" * payload)


#: What `encode` put in, by arithmetic: lengths of the frames repeat after six, so offsets and the number of frames are closed forms.
SQL = f"""
WITH a AS (SELECT doc_id AS s, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 8 AS nb FROM documents WHERE doc_id >= 0),
b AS (SELECT *, s % 3 AS v, [3, 3, 2, 1][(s // 3) % 4 + 1] AS layer, (s // 12) % 2 = 1 AS mono, (s // 96) % 2 = 1 AS prot, (s // 192) % 6 AS tags, s % 13 = 0 AS free, s % 7 = 0 AS stray, s % 11 = 0 AS cut,
  [[44100, 48000, 32000], [22050, 24000, 16000], [11025, 12000, 8000]][s % 3 + 1][(s // 1152) % 3 + 1] AS hz FROM a),
c AS (SELECT *, (s // 3456) % 2 = 1 AND NOT free AS vbr, CASE WHEN layer = 3 THEN [NULL, 'Xing', 'Info', 'VBRI'][(s // 24) % 4 + 1] END AS "table", prot AND s % 5 = 0 AS bad, CASE WHEN layer = 1 THEN 384 WHEN layer = 2 OR v = 0 THEN 1152 ELSE 576 END AS per,
  CASE WHEN v = 0 THEN [[160, 192, 224, 384], [80, 96, 112, 256], [64, 80, 96, 224]][layer] ELSE [[80, 96, 112, 192], [40, 48, 56, 128], [40, 48, 56, 128]][layer] END AS kbps FROM b),
d AS (SELECT *, list_transform(range(7), lambda i: CASE WHEN free THEN {FREE_BASE} + (i % 2) * CASE WHEN layer = 1 THEN 4 ELSE 1 END
  WHEN layer = 1 THEN (12000 * kbps[CASE WHEN i = 0 THEN 4 WHEN vbr THEN i % 3 + 1 ELSE 1 END] // hz + i % 2) * 4
  ELSE per // 8 * 1000 * kbps[CASE WHEN i = 0 THEN 4 WHEN vbr THEN i % 3 + 1 ELSE 1 END] // hz + i % 2 END) AS len FROM c),
e AS (SELECT *, list_transform(range(7), lambda i: coalesce(list_sum(len[2 : i + 1]), 0)::BIGINT) AS sums, 4 + 2 * prot::INT AS head FROM d),
f AS (SELECT *, list_transform(range(7), lambda i: sums[i + 1] - i * head) AS held FROM e),
g AS (SELECT *, greatest(8, 1 + 6 * (nb // held[7]) + len(list_filter(held[1:6], lambda x: x < nb % held[7]))) AS n FROM f),
h AS (SELECT *, n - ("table" IS NOT NULL)::INT AS frames, CASE WHEN tags IN (1, 2, 5) THEN 21 + length('doc ' || s) ELSE 0 END AS front FROM g),
k AS (SELECT *, frames * per - CASE WHEN "table" = 'Info' THEN 1576 ELSE 0 END AS samples FROM h)
SELECT s AS doc_id, ['1', '2', '2.5'][v + 1] AS version, layer, hz AS sample_rate, 2 - mono::INT AS channels, frames::BIGINT AS frames, samples::BIGINT AS samples, ((samples * 1000000 + hz // 2) // hz)::BIGINT AS duration_us,
  coalesce("table" IN ('Xing', 'VBRI'), NOT free) OR vbr AS vbr, "table", CASE WHEN "table" IS NOT NULL THEN n + cut::INT - 1 END::BIGINT AS declared_frames,
  CASE WHEN "table" IS NULL THEN '' WHEN "table" = 'VBRI' THEN array_to_string(list_transform(range(20), lambda i: 3 * (i + 1)), ' ') ELSE array_to_string(list_transform(range(100), lambda i: i * 255 // 99), ' ') END AS toc,
  CASE WHEN tags IN (1, 2, 3, 5) THEN 'doc ' || s END AS title, NULL::VARCHAR AS artist, (4 * stray::INT + cut::INT * (len[(n - 2) % 6 + 2] // 2))::BIGINT AS skipped_bytes, cut AS truncated,
  CASE WHEN prot THEN n - bad::INT ELSE 0 END::BIGINT AS crc_ok, bad::BIGINT AS crc_bad,
  array_to_string(list_transform(range(n - frames, n), lambda i: front + CASE WHEN i = 0 THEN 0 ELSE len[1] + ((i - 1) // 6) * sums[7] + sums[(i - 1) % 6 + 1] END + 4 * (stray AND i >= 5)::INT), ' ') AS seek,
  octet_length(encode(t)) AS payload_bytes, md5(t) AS payload_md5
FROM k
"""
