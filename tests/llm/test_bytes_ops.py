"""WARC records and MPEG audio."""

import gzip
import hashlib
import random

from mhr.llm import mpeg, warc


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id bigint, url string, html string, chunk_no int")


def test_warc_round_trip(spark):
    r = random.Random(1)
    rows = [(i, f"http://x.example/{i}", "".join(r.choices("abcé\r\n WARC/", k=r.choice([0, 10, 16_384, 50_000])))) for i in range(40)] + [(99, None, "x"), (None, "u", "y"), (98, "u", None), (7, "same", "z"), (7, "same", "z")]
    got = warc.read_chunks(warc.write_warc(pages(spark, rows)))
    parts = {}
    for x in got.collect():
        parts.setdefault((x.record_id, x.page_id, x.target_uri), []).append(x)
    want = {(warc.record_id(i, u, h), i, u): h for i, u, h in rows if h is not None}
    assert parts.keys() == want.keys()
    for key, chunks in parts.items():
        body = want[key].encode()
        copies = sum(x.last for x in chunks)
        chunks = sorted(chunks, key=lambda x: x.chunk_no)[::copies]
        assert b"".join(bytes(x.payload) for x in chunks) == body and all(len(x.payload) <= warc.CHUNK for x in chunks)
        assert all(x.sha1 == hashlib.sha1(body[: x.offset + x.n_bytes]).hexdigest() for x in chunks)
        assert chunks[-1].last and chunks[-1].digest_ok and not chunks[-1].truncated
    whole = sorted((x.record_id, bytes(x.payload).decode()) for x in warc.assembled(got).collect())
    assert whole == sorted((warc.record_id(i, u, h), h) for i, u, h in rows if h is not None)
    assert warc.read_chunks(warc.write_warc(pages(spark, []))).count() == 0


def test_warc_files_of_others(spark, tmp_path):
    record = lambda body, n=None: b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body) if n is None else n, body)
    (tmp_path / "plain.warc").write_bytes(b"junk" + record(b"one") + b"more junk" + record(b"two" * 9000))
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(record(b"three")) + gzip.compress(record(random.Random(2).randbytes(5000)))[:-600])
    (tmp_path / "short.warc").write_bytes(record(b"five", 500))
    (tmp_path / "empty.warc").write_bytes(b"")
    get = lambda name: sorted(((x.chunk_no, bytes(x.payload), x.last, x.truncated) for x in warc.read_warc(spark, [str(tmp_path / name)]).collect()))
    assert [x[1] for x in get("plain.warc")] == [b"one", (b"two" * 9000)[:16_384], (b"two" * 9000)[16_384:]]
    assert get("short.warc")[0][2:] == (True, True) and get("empty.warc") == []
    assert (0, b"three", True, False) in get("cut.warc.gz")


def test_warc_damaged_files(spark, tmp_path):
    r = random.Random(6)
    record = lambda body, extra=b"": b"WARC/1.0\r\nWARC-Type: resource\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (extra, len(body), body)
    first, second, third = (gzip.compress(record(r.randbytes(200_000))) for _ in range(3))
    last = gzip.compress(record(b"after all"))
    for at in (20, 700, 100_000, len(second) - 5):  # in the header, behind it, amid, in the trailer
        damaged = bytearray(second)
        damaged[at : at + 40] = r.randbytes(len(damaged[at : at + 40]))
        (tmp_path / "d.warc.gz").write_bytes(first + bytes(damaged) + third + last)
        got = warc.read_warc(spark, [str(tmp_path / "d.warc.gz")]).collect()
        sizes = {}
        for x in got:
            sizes[x.record_no] = sizes.get(x.record_no, 0) + x.n_bytes
        assert list(sizes.values()).count(200_000) >= 2 and bytes(got[-1].payload) == b"after all", at
        assert at < 100 or at > 190_000 or any(x.truncated for x in got)
    long = b"X-Long: " + b"v" * (2 << 20) + b"\r\nWARC-Target-URI: http://a/" + b"u" * 100_000 + b"\r\n"
    http = b"HTTP/1.1 200 OK\r\nX-Long: " + b"h" * (3 << 20) + b"\r\n\r\nbody"
    (tmp_path / "long.warc").write_bytes(record(b"held", long) + record(http, b"Content-Type: application/http\r\n") + record(b"HTTP/1.1 200 OK\r\nno end", b"Content-Type: application/http\r\n") + b"WARC/1.0\r\nWARC-Type: lost\r\n\r\n" + record(b"plain", b"Content-Type: application/http\r\n") + b"WARC/1.0\r\nWARC-Ty")
    got = sorted(warc.read_warc(spark, [str(tmp_path / "long.warc")]).collect(), key=lambda x: x.record_no)
    assert [(bytes(x.payload), x.warc_type, x.truncated) for x in got] == [(b"held", "resource", False), (b"body", "resource", False), (b"", "resource", False), (b"", "lost", True), (b"plain", "resource", False), (b"", None, True)]
    assert len(got[0].target_uri) == 100_009


def test_mpeg_odd_rows(spark):
    r = random.Random(3)
    noise = bytes(r.randrange(256) for _ in range(5000))
    rows = [(1, None), (2, b""), (3, noise), (7, b"\xff" * 3000), (None, mpeg.encode(5, b"x")), (4, mpeg.encode(8, b"x")), (4, mpeg.encode(8, b"x")), (5, b"ID3\x03\0\0\x7f\x7f\x7f\x7f"), (6, mpeg.encode(6, b"x") * 200)]
    got = mpeg.mpeg_columns(spark.createDataFrame([(i, m, 1) for i, m in rows], "doc_id bigint, media binary, frames int")).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(rows) and by[1].frames == by[2].frames == by[5].frames == 0 and by[1].duration_us is None
    assert by[None].frames > 0 and by[6].frames > 1000 and sum(x.doc_id == 4 for x in got) == 2
    assert mpeg.mpeg_columns(spark.createDataFrame([], "doc_id bigint, media binary")).count() == 0


def test_mpeg_whole_texts(spark):
    r, seen = random.Random(4), set()
    for seed in range(1, 1500):
        text = r.randbytes(r.choice([0, 1, 3_000, 20_000, 133_719 if seed % 100 == 0 else 9]))
        k, data = mpeg.Kind.of(seed), mpeg.encode(seed, text)
        a = mpeg.parse(data)
        assert mpeg.decode(seed, data, a) == text
        assert (a.version, a.layer, a.channels, a.table) == (k.version, k.layer, 2 - k.mono, k.table) and a.truncated == k.cut
        assert a.title == (f"doc {seed}" if "ID3" in k.tags else None) and a.crc_bad == k.bad
        assert (a.crc_ok > 0) == k.protected and (not k.protected or a.crc_ok + a.crc_bad == a.frames + (k.table is not None))
        per = mpeg.header_at(data, a.seek[0]).samples
        assert a.samples == a.frames * per - (1576 if k.table == "Info" else 0) and (k.table is None or a.declared_frames == a.frames + k.cut)
        last = mpeg.header_at(data, a.seek[-1])
        length = mpeg.FREE_BASE + last.padding if k.free else last.length
        assert a.skipped_bytes == 4 * k.stray + (length // 2 if k.cut else 0)
        seen |= {k.version, k.layer, k.mono, k.table, k.tags, k.free, k.stray and b"\xff" in data[a.seek[4] + 4 :], ("free", k.free, k.layer), ("crc", k.protected, k.layer)}
    assert seen >= {"1", "2", "2.5", 1, 2, 3, True, False, None, "Xing", "Info", "VBRI", "ID3v2.3", "ID3v2.4", "ID3v1", "APE"}
    assert seen >= {(x, True, n) for x in ("free", "crc") for n in (1, 2, 3)}
    rows = [(3, "long \u00e9 " * 20_000), (4, None), (5, "x"), (5, "x"), (None, "x"), (6, "\u00ff" * 5000)]
    media = mpeg.synthetic_media(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = mpeg.mpeg_columns(media, payload=True).collect()
    assert sorted((x.doc_id, bytes(x.payload)) for x in got) == sorted((i, (t or "").encode()) for i, t in rows if i is not None)


def test_mpeg_layer_two_checksum_by_bits():
    """The protected bits by a reader of single bits, on frames of all tables."""
    r = random.Random(9)
    for index, rate, mode, version in [(i, f, m, v) for i in (1, 4, 8, 14) for f in (0, 1, 2) for m in (0, 0b0101, 0b1100) for v in (3, 2)]:
        head = bytes([0xFF, 0xE0 | version << 3 | 2 << 1, index << 4 | rate << 2, mode << 4])
        h = mpeg.header_at(head, 0)
        kbps = h.bitrate / (1 if h.mono else 2)
        if version == 2:
            bands = [4] * 4 + [3] * 7 + [2] * 19
        elif kbps <= 48:
            bands = [4, 4] + [3] * (10 if h.rate == 32000 else 6)
        else:
            bands = [4] * 11 + [3] * 12 + [2] * (7 if kbps >= 96 and h.rate != 48000 else 4)
        body = r.randbytes(60)
        bits = "".join(f"{x:08b}" for x in body)
        bound = 8 if mode == 0b0101 else 0 if h.mono else 99
        at, used = 0, 0
        for band, n in enumerate(bands):
            for _ in range(2 if band < bound else 1):
                used += ("1" in bits[at : at + n]) * (2 if mode == 0b0101 and band >= bound else 1)
                at += n
        assert mpeg.checked_bits(h, mode, body) == at + 2 * used
        crc = 0xFFFF
        for bit in f"{head[2]:08b}{head[3]:08b}" + bits[: at + 2 * used]:
            crc = (crc << 1) & 0xFFFF ^ (0x8005 if (crc >> 15) ^ int(bit) else 0)
        assert mpeg.checksum(head, h, body) == crc


def test_mpeg_false_sync_near_the_end():
    data = mpeg.encode(2, b"x")
    a = mpeg.parse(data)
    p, q = a.seek[-2:]
    false = data[p : p + 2] + b"\xe0" + data[p + 3 : p + 4]  # a header that reaches beyond the end
    b = mpeg.parse(data[:q] + b"\0" + false + data[q:])
    assert b.frames == a.frames and not b.truncated and b.skipped_bytes == 5
