"""Operator 2: WARC files and the chunked record table.

`write_warc` streams pages into gzip-per-record files in a shared folder; `read_chunks` streams them back as rows
(record_id, chunk_no, ...) of bounded size, each with the digest of the payload up to its end.  A record is never held
whole: the reader keeps one chunk and the state of the digest, and headers pass line by line, of any length.  Files are read
in ranges of records where a manifest names them, else whole, by one task a file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Payload bytes of a row; compressed bytes after which the writer notes a new range; bytes read at a time.
CHUNK, RANGE, READ = 16_384, 8 << 20, 65_536

_MANIFEST = "path string, start bigint, stop bigint, records bigint"
_ROWS = "path string, range_start bigint, record_no bigint, record_id string, warc_type string, target_uri string, page_id bigint, chunk_no bigint, offset bigint, n_bytes bigint, payload binary, sha1 string, last boolean, digest_ok boolean, truncated boolean"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def record_id(page_id: int | None, url: str | None, html: str) -> str:
    return f"urn:uuid:{uuid.UUID(hashlib.md5(f'{'' if page_id is None else page_id}|{url or ''}|{html}'.encode()).hexdigest())}"


def record_head(page_id: int | None, url: str | None, html: str, body: bytes) -> bytes:
    """WARC and HTTP headers of a response record for `body`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    lines = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <{record_id(page_id, url, html)}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {url}"] if url else []
    lines += [f"WARC-Page-ID: {page_id}"] if page_id is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        path, out, rows, at, start, records = f"{uuid.uuid4().hex}.warc.gz", None, [], 0, 0, 0
        for batch in batches:
            for i, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(f"{base}/{path}", compression=None)
                body = html.encode()
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                for part in (record_head(i, url, html, body), *(memoryview(body)[k : k + READ] for k in range(0, len(body), READ)), b"\r\n\r\n"):
                    at += out.write(z.compress(part))
                at += out.write(z.flush())
                records += 1
                if at - start >= RANGE:
                    rows.append((f"{folder}/{path}", start, at, records))
                    start, records = at, 0
        if records:
            rows.append((f"{folder}/{path}", start, at, records))
        if out is not None:
            out.close()
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["path", "start", "stop", "records"])

    return run


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes one response record a page and returns the manifest (path, start, stop, records), itself stored.

    Only files of tasks that ended well are in the manifest, so retried tasks leave no doubles.  A null html has no record;
    an empty one has an empty payload; null urls and ids have no header line; an empty table writes nothing.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/mhr/warc-{uuid.uuid4().hex}"
    flat = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).where("html is not null")
    return stored(flat.mapInArrow(_written(folder), _MANIFEST), "manifest")


class Inflated:
    """Bytes of a stream, inflated over gzip members if it is gzip; `limit` is where to stop in the raw stream.

    Where a member is damaged the bytes end (`gap`), until `resume` goes on with the next member.
    """

    def __init__(self, raw: BinaryIO, limit: int | None = None):
        self.raw, self.left, self.buf, self.done, self.gap, self.begun = raw, limit, b"", False, False, False
        self.spare = self._read()
        self.z = zlib.decompressobj(31) if self.spare[:2] == MAGIC[:2] else None
        self.broken = False

    def _read(self) -> bytes:
        n = READ if self.left is None else min(READ, self.left)
        data = self.raw.read(n) if n else b""
        if self.left is not None:
            self.left -= len(data)
        return data

    def fill(self) -> bool:
        """Adds some bytes to buf; False at the end or at a gap."""
        while not self.done and not self.gap:
            data = self.spare or self._read()
            self.spare = b""
            if not data:
                self.done = True
                self.broken |= self.begun
                break
            if self.z is None:
                self.buf += data
                return True
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            try:
                more = self.z.decompress(data, READ)
            except zlib.error:
                self.gap = self.broken = True
                self.spare = data[1:]
                break
            self.begun = not self.z.eof
            self.spare = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if more:
                self.buf += more
                return True
        return False

    def resume(self) -> bool:
        """Behind a gap, goes to the next place where a gzip member may begin; False at the end."""
        if not self.gap:
            return False
        self.gap = self.broken = self.begun = False
        while (k := self.spare.find(MAGIC)) < 0:
            more = self._read()
            if not more:
                self.done = True
                return False
            self.spare = self.spare[-2:] + more
        self.spare, self.z = self.spare[k:], zlib.decompressobj(31)
        return True

    def line(self, most: int | None = None, keep: tuple[bytes, ...] | None = None) -> tuple[bytes, int] | None:
        """The next line without its end, and the bytes that it takes; None if the bytes end first, or after `most`.

        With `keep`, of a line that doesn't begin with one of these only a beginning is kept, so that memory is bounded.
        """
        held, size, seen = b"", 0, 0
        while True:
            k = self.buf.find(b"\n", seen)
            if most is not None and size + (len(self.buf) if k < 0 else k + 1) > most:
                k = most - size
                self.buf = self.buf[k:]
                return None
            if k >= 0:
                line, self.buf = held + self.buf[:k], self.buf[k + 1 :]
                return line.removesuffix(b"\r"), size + k + 1
            seen = len(self.buf)
            if keep is not None and size + len(self.buf) > 64 and not (held + self.buf[:64]).lower().startswith(keep):
                held, size, seen, self.buf = held or self.buf[:64], size + len(self.buf) - 1, 0, self.buf[-1:]
            if not self.fill():
                return None

    def some(self, n: int) -> bytes:
        """Up to n bytes; empty at the end or at a gap."""
        if not self.buf:
            self.fill()
        out, self.buf = self.buf[:n], self.buf[n:]
        return out


MAGIC = b"\x1f\x8b\x08"
_NAMED = (b"content-length:", b"content-type:", b"warc-record-id:", b"warc-type:", b"warc-target-uri:", b"warc-page-id:", b"warc-payload-digest:")


def _head(src: Inflated) -> dict[str, str] | None:
    """The named fields of a record's header; None if the bytes end in it."""
    out: dict[str, str] = {}
    while (got := src.line(keep=_NAMED)) is not None:
        if not got[0]:
            return out
        if got[0].lower().startswith(_NAMED):
            name, _, value = got[0].decode("utf-8", "replace").partition(":")
            out[name.lower()] = value.strip()
    return None


def chunks(src: Inflated, size: int) -> Iterator[tuple]:
    """Rows (record_no, ...) of all records of a stream.  Bytes that are no record are passed over up to the next "WARC/" at
    the beginning of a line or member; a record without a length is told by one row without payload, truncated."""
    record = -1
    while True:
        while (k := src.buf.find(b"WARC/")) < 0:
            src.buf = src.buf[-4:]
            if not src.fill():
                src.buf = b""
                if not src.resume():
                    return
        src.buf = src.buf[k:]
        f, record = _head(src), record + 1
        broken = f is None or not f.get("content-length", "").isdigit()
        f = f or {}
        left, told = 0 if broken else int(f["content-length"]), f.get("warc-payload-digest", "")
        if left and f.get("content-type", "").startswith("application/http"):
            left = _without_http(src, left)
        digest, offset, number, held = hashlib.sha1(), 0, 0, bytearray()
        page = f.get("warc-page-id", "")
        base = (record, f.get("warc-record-id", "").strip("<>") or None, f.get("warc-type"), f.get("warc-target-uri"), int(page) if page.isdigit() else None)
        cut = broken
        while True:
            while left and len(held) < size:
                part = src.some(min(left, size - len(held)))
                if not part:
                    cut = True
                    break
                held += part
                left -= len(part)
            last = cut or not left
            digest.update(held)
            good = digest.digest() == base64.b32decode(told[5:]) if last and not broken and told.startswith("sha1:") and len(told) == 37 else None
            yield (*base, number, offset, len(held), bytes(held), digest.hexdigest(), last, good, cut if last else False)
            offset, number, held = offset + len(held), number + 1, bytearray()
            if last:
                break
        if cut and src.gap:
            src.buf = b""
            src.resume()


def _without_http(src: Inflated, left: int) -> int:
    """Passes the header of an HTTP message, if there is one, and says how many bytes are left; 0 if all is header."""
    while len(src.buf) < min(5, left) and src.fill():
        pass
    if not src.buf.startswith(b"HTTP/"):
        return left
    while left and (got := src.line(left, keep=())) is not None:
        left -= got[1]
        if not got[0]:
            return left
    return 0


_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


def _chunked(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)

        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns[:3])):
                system, name = _open(path)
                with system.open_input_file(name) as raw:
                    raw.seek(start or 0)
                    for row in chunks(Inflated(raw, None if stop is None else stop - (start or 0)), size):
                        rows.append((path, start or 0, *row))
                        held += row[7] + 300
                        if held >= 4 << 20:
                            yield out()
                            rows, held = [], 0
        if rows:
            yield out()

    return run


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """The chunked record table of the files or ranges in `manifest` (path, and start, stop or null).

    Chunk k of a record holds payload bytes offset .. offset + n_bytes - 1 (after the HTTP header in records of http
    messages), sha1 the digest of the payload up to its end.  The last chunk says whether the record's payload digest holds
    (null if it has none) and whether the stream broke off in it.  An empty payload is one chunk of 0 bytes.  Repeated
    records come as often as they stand, told apart by (path, range_start, record_no); headers that are missing are null.
    Bytes between records are passed over; a record whose length is missing is one empty chunk with `truncated`; behind a
    damaged gzip member reading goes on with the next one.  Counts the manifest while the result is built.
    """
    n = max(1, manifest.count())
    return manifest.select("path", "start", "stop").repartition(min(n, 10_000), "path", "start").mapInArrow(_chunked(chunk_bytes), _ROWS)


def read_warc(spark: SparkSession, paths: list[str], chunk_bytes: int = CHUNK) -> DataFrame:
    """The chunked record table of .warc or .warc.gz files."""
    return read_chunks(spark.createDataFrame([(p, None, None) for p in paths], "path string, start bigint, stop bigint"), chunk_bytes)


def assembled(rows: DataFrame) -> DataFrame:
    """(record_id, payload BINARY), a row for each record as it stands: payloads put together again, for those that need
    them whole.  Records that repeat give a row each; a null record_id stays null."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "payload")))  # the chunks of one record
    whole = rows.groupBy("path", "range_start", "record_no").agg(F.first("record_id").alias("record_id"), parts.alias("p"))
    return whole.select("record_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["payload"])).alias("payload"))


SQL = f"""
WITH p AS (SELECT page_id, url, encode(html) AS b, md5(concat(coalesce(page_id::VARCHAR, ''), '|', coalesce(url, ''), '|', html)) AS h, octet_length(encode(html)) AS n FROM pages WHERE html IS NOT NULL),
c AS (SELECT *, unnest(range(greatest(1, (n + {CHUNK - 1}) // {CHUNK}))) AS chunk_no FROM p)
SELECT concat('urn:uuid:', h[1:8], '-', h[9:12], '-', h[13:16], '-', h[17:20], '-', h[21:32]) AS record_id, 'response' AS warc_type, url AS target_uri, page_id, chunk_no, chunk_no * {CHUNK} AS "offset",
  least({CHUNK}, n - chunk_no * {CHUNK})::BIGINT AS n_bytes, base64(b[chunk_no * {CHUNK} + 1 : (chunk_no + 1) * {CHUNK}]) AS payload_base64, sha1(b[1 : (chunk_no + 1) * {CHUNK}]) AS sha1,
  (chunk_no + 1) * {CHUNK} >= n AS last, CASE WHEN (chunk_no + 1) * {CHUNK} >= n THEN true END AS digest_ok, false AS truncated
FROM c
"""
