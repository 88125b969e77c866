"""WARC files: a writer, and a reader that salvages what it can of damaged ones.

The reader takes gzip members or plain records one after the other. A record counts if its version line, headers and length hold,
what follows it is the end, a member or a version line, and its block has the digest that its header names. Where a check fails
it searches for the next member or version line from which a record counts, goes on there, and logs the bytes between as a gap
with the reason. Within a member the same search goes over what it inflates to: a bad record costs itself, and its gap names the
inflated bytes. Of a member that is cut or that stops inflating, the records before that place are kept if they have a digest
and it is right, and the member is logged as a gap too. Files are read in byte ranges, as lines of text are: a range has the
records that begin in it, and the gaps up to the first record that begins after it.

Defined results: an empty file, or null content, has no records and no gaps; a truncated record is a gap to the end; records of a
type other than those asked for are skipped and are no gaps; equal records are all returned, each in its place. Records and headers
may be of any length: a range reads on to the end of the last record that begins in it; a member has to fit in memory. In plain
files, records inside the body of a record that is longer than a range are also found by the ranges that begin in that body. Pages
whose url or html is null aren't written; a page_id that is null or isn't a number makes a record without a page_id. Other columns
aren't read, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r?\n")


class NeedMore(Exception):
    """The buffer ends, and the file does not."""


@dataclass
class Found:
    kind: str  # record or gap
    start: int
    end: int
    reason: str = ""
    headers: dict | None = None
    block: bytes = b""


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record(headers: dict[str, str], block: bytes, compress: bool = True) -> bytes:
    """One record, as a gzip member of its own unless compress is off."""
    h = {**headers, "WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    raw = b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in h.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0) if compress else raw


def response(url: str, html: str, record_id: str, compress: bool = True) -> bytes:
    body = html.encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
    uri = "".join(c for c in url if c not in "\r\n")
    return record({"WARC-Type": "response", "WARC-Record-ID": f"<{record_id}>", "WARC-Target-URI": uri, "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/http; msgtype=response"}, block, compress)


def parse_headers(raw: bytes) -> dict[str, str] | None:
    out: dict[str, str] = {}
    for line in raw.split(b"\n"):
        line = line.rstrip(b"\r")
        if not line:
            continue
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        out[k.strip().decode("latin-1").lower()] = v.strip().decode("utf-8", "replace")
    return out


class Blank:
    """Where the next empty line of a buffer is; answers are kept, so that a run of version lines without one is read once."""

    def __init__(self, buf: bytes) -> None:
        self.buf, self.asked, self.found = buf, {}, {}

    def after(self, mark: bytes, at: int) -> int:
        if mark not in self.asked or not (self.asked[mark] <= at and (self.found[mark] < 0 or at <= self.found[mark])):
            self.asked[mark], self.found[mark] = at, self.buf.find(mark, at)
        return self.found[mark]


def plain_record(buf: bytes, at: int, rest: int, blank: Blank | None = None) -> tuple[Found | None, str, int]:
    """The record at a place of plain WARC bytes: it and its end, or why there is none. rest: bytes of the file beyond buf."""
    m = VERSION.match(buf, at)
    if not m:
        if rest and len(buf) - at < 16:
            raise NeedMore
        return None, "no version line", at
    blank = blank or Blank(buf)
    ends = [(i, i + len(x)) for x in (b"\r\n\r\n", b"\n\n") if (i := blank.after(x, m.end())) >= 0]
    if not ends:
        if rest:
            raise NeedMore
        return None, "no end of headers", at
    stop, body = min(ends)
    headers = parse_headers(buf[m.end() : stop])
    if headers is None or not headers.get("content-length", "").isdigit():
        return None, "bad headers", at
    end = body + int(headers["content-length"])
    if end > len(buf) + rest:
        return None, "truncated", at
    if rest and end + 16 > len(buf):
        raise NeedMore
    block = buf[body:end]
    after = end
    while after < len(buf) and after < end + 4 and buf[after] in b"\r\n":
        after += 1
    if after < len(buf) and not VERSION.match(buf, after) and not buf.startswith(MAGIC, after):
        return None, "bad length", at
    named = headers.get("warc-block-digest", "")
    if named.startswith("sha1:") and named != digest(block):
        return None, "bad digest", at
    return Found("record", at, after, "", headers, block), "", after


def inflated(buf: bytes, at: int) -> tuple[bytes, str, int]:
    """What the gzip member at a place inflates to, why it ends early if it does, and where it ends. It is fed in pieces, so that a member costs its own length and not the buffer's."""
    view, out = memoryview(buf), []
    d = zlib.decompressobj(31)
    k, step = at, 4096
    while k < len(buf) and not d.eof:
        piece = view[k : k + step]
        before = d.copy()
        try:
            out.append(d.decompress(piece))
        except zlib.error:
            for size in (512, 16):  # as near to the damage as small pieces come
                while len(piece):
                    d = before.copy()
                    try:
                        out.append(d.decompress(piece[:size]))
                    except zlib.error:
                        break
                    before, piece = d, piece[size:]
            return b"".join(out), "bad member", at
        k += len(piece)
        step = min(2 * step, 1 << 18)
    return b"".join(out), "" if d.eof else "truncated", k - len(d.unused_data)


def member(buf: bytes, at: int, rest: int) -> tuple[list[Found], str, int]:
    """The records of the gzip member at a place, with gaps between them, and its end; if it isn't whole, those that their digests vouch for, and why."""
    raw, why, end = inflated(buf, at)
    if why == "truncated" and rest:
        raise NeedMore
    out: list[Found] = []
    blank, k, gap = Blank(raw), 0, None
    first = ""
    while k < len(raw):
        got, bad, after = plain_record(raw, k, 0, blank)
        if got and why and not got.headers.get("warc-block-digest", "").startswith("sha1:"):
            got, bad = None, why
        if got:
            if gap is not None and not why:
                out.append(Found("gap", at, end, f"{gap[1]} in inflated bytes {gap[0]} to {k}"))
            gap = None
            got.start, got.end = at, end
            out.append(got)
            k = after
        else:
            gap = gap or (k, bad)
            first = first or bad
            m = VERSION.search(raw, k + 1)
            k = m.start() if m else len(raw)
    records = any(f.kind == "record" for f in out)
    if records and gap is not None and not why:
        out.append(Found("gap", at, end, f"{gap[1]} in inflated bytes {gap[0]} to {len(raw)}"))
    if why:
        return out, why, at
    return (out, "", end) if records else ([], first or "empty member", at)


def records_at(buf: bytes, at: int, rest: int, blank: Blank | None = None) -> tuple[list[Found], str, int]:
    """What counts at a place, why it doesn't or not all of it does, and its end."""
    if buf.startswith(MAGIC, at):
        return member(buf, at, rest)
    got, why, end = plain_record(buf, at, rest, blank)
    return ([got] if got else []), why, end


MARKS = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")


def candidates(buf: bytes, at: int) -> Iterator[int]:
    """Places from at on where a member or a version line may begin; after a truncated record that need not be a new line."""
    for m in MARKS.finditer(buf, at):
        yield m.start()


def next_valid(buf: bytes, at: int, rest: int, blank: Blank | None = None) -> int:
    """Where the next record that counts begins; the end where there is none."""
    for c in candidates(buf, at):
        found, _, _ = records_at(buf, c, rest, blank)
        if found:
            return c
    if rest:
        raise NeedMore
    return len(buf)


def salvage(buf: bytes, first: bool = True, limit: int | None = None, rest: int = 0) -> Iterator[Found]:
    """Records that begin before limit and gaps up to the first record after it. first: the file begins here; otherwise what comes before the first valid record is the range's before. rest: bytes of the file beyond buf."""
    limit = len(buf) if limit is None else limit
    blank = Blank(buf)
    at = 0 if first else next_valid(buf, 0, rest, blank)
    while at < len(buf):
        found, why, end = records_at(buf, at, rest, blank)
        if found and at >= limit:
            return
        yield from found
        if found and not why:
            at = end
        else:
            start, at = at, next_valid(buf, at + 1, rest, blank)
            yield Found("gap", start, at, why)
        if at >= len(buf) and rest:
            raise NeedMore


def html_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


SCHEMA = "path string, kind string, start bigint, end bigint, reason string, record_id string, url string, type string, payload binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [p.split()[0] for p in SCHEMA.split(", ")])


def _rows(path: str, found: Iterator[Found], base: int, types: tuple) -> Iterator[tuple]:
    for f in found:
        if f.kind == "gap":
            yield path, "gap", base + f.start, base + f.end, f.reason, None, None, None, None
        elif not types or f.headers.get("warc-type") in types:
            h = f.headers
            yield path, "record", base + f.start, base + f.end, None, h.get("warc-record-id", "").strip("<>"), h.get("warc-target-uri"), h.get("warc-type"), f.block


def salvaged(blobs: DataFrame, types: tuple = ("response",)) -> DataFrame:
    """Records and gaps of whole archives: blobs has path and content."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for r in _rows(path, salvage(content or b""), 0, types):
                    rows.append(r)
                    held += len(r[-1] or b"")
                    if held > 8_000_000:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    return blobs.select("path", "content").mapInArrow(each, SCHEMA)


def read_warc(spark: SparkSession, path: str, types: tuple = ("response",), range_bytes: int = 64 << 20) -> DataFrame:
    """Records and gaps of the WARC files under a path that every executor reaches, in byte ranges."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    ranges = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(size - 1) div {range_bytes}"))).alias("k")).select("path", "size", (F.col("k") * range_bytes).alias("start"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for p, size, start in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                system, name = fs.FileSystem.from_uri(p)
                extra = 1 << 20
                while True:
                    stop = min(size, start + range_bytes + extra)
                    with system.open_input_file(name) as f:
                        f.seek(start)
                        buf = f.read(stop - start)
                    try:
                        rows = list(_rows(p, salvage(buf, start == 0, range_bytes, size - stop), start, types))
                        break
                    except NeedMore:
                        extra *= 4
                yield _batch(rows)

    return ranges.repartition(max(1, spark.sparkContext.defaultParallelism), "path", "start").mapInArrow(each, SCHEMA)


def archived(pages: DataFrame, damage_every: int = 0, damage_at: int = 0, blob_bytes: int = 8 << 20, compress: bool = True) -> DataFrame:
    """pages (page_id, url, html) as archives of about blob_bytes: path, content. damage_every overwrites bytes in the middle of the record of each page whose page_id % damage_every is damage_at."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        held = 0
        name = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{name}.warc"]), pa.array([b"".join(parts)], pa.binary())], ["path", "content"])

        for b in batches:
            for i, url, html in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                r = response(url, html, f"urn:page:{i}", compress)
                if damage_every and i is not None and i % damage_every == damage_at:
                    r = bytearray(r)
                    m = len(r) // 2
                    r[m : m + 24] = bytes(x ^ 0x5A for x in r[m : m + 24])
                    r = bytes(r)
                name = i if name is None else name
                parts.append(r)
                held += len(r)
                if held >= blob_bytes:
                    yield out()
                    parts, held, name = [], 0, None
        if parts:
            yield out()

    d = pages.select("page_id", "url", "html").where("url is not null and html is not null")
    return d.mapInArrow(each, "path string, content binary")


def pages_of(found: DataFrame) -> DataFrame:
    """kind, page_id, url, html_md5 of salvaged page archives; gaps have a kind only."""

    @F.pandas_udf("string")
    def md5(blocks: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else hashlib.md5(html_of(x)).hexdigest() for x in blocks], dtype=object)

    number = F.regexp_extract("record_id", "^urn:page:(\\d+)$", 1)
    return found.select("kind", F.when(number != "", number.cast("bigint")).alias("page_id"), "url", md5("payload").alias("html_md5"))


def salvage_pages(spark: SparkSession, sf_dir: str, damage_every: int = 50, damage_at: int = 7) -> DataFrame:
    """The pages table, archived with every 50th record damaged, and salvaged: kind, page_id, url, html_md5."""
    return pages_of(salvaged(archived(table(spark, sf_dir, "pages"), damage_every, damage_at)))
