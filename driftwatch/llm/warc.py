"""WARC derivatives: from responses to linked metadata and plain-text conversion records.

``responses`` makes one response record per page.  ``derive`` turns every response into
itself and two derivatives that carry its identifier as WARC-Refers-To, its target URI
and date, and its digests; the metadata record lists the source's HTTP headers, title,
language and links, the conversion record holds the visible text.  ``write_warc`` writes
records to WARC files, each a gzip member of its own, ``read_warc`` reads these and others as a stream.  Pages are gone through from left to right,
each part a bounded number of times.

Record ids are UUIDs made from the page's id, URL and record type, so a re-run after a lost
executor gives the same records.  Digests are ``sha1:`` in base 32, over the block
(WARC-Block-Digest) and over the HTTP body or text (WARC-Payload-Digest).

Defined results: a null URL or page is empty (a response with an empty body, a conversion
record with an empty text); repeated rows give repeated records with equal ids; an empty table gives no
records; extra columns are ignored; pages of any length are handled whole.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import itertools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Date of all records, as the pages carry none.
DATE = "2024-01-01T00:00:00Z"
HTTP = ("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8")

RECORD = ("page_id bigint, kind string, record_id string, refers_to string, url string, date string, "
          "content_type string, block_digest string, payload_digest string, block binary")

#: What begins a stretch that isn't shown: a comment, an element whose content isn't text, or the doctype.
_HIDDEN = re.compile(r"(?i)<(?:(!--)|(script|style|noscript|template)\b|(!doctype))")
_CLOSING = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "noscript", "template", "head", "title")}
_HEAD = re.compile(r"(?i)<head\b")
_TITLE = re.compile(r"(?i)<title")
_HTML = re.compile(r"(?i)<html\b")
_LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?([\w-]+)")
_ANCHOR = re.compile(r"(?i)<a\b")
_HREF = re.compile(r"(?i)\bhref\s*=\s*")
_BARE = re.compile(r"[^\s>]+")
_BLOCK = re.compile(r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|"
                    r"header|hr|li|main|nav|ol|p|pre|section|table|tr|ul)\b[^>]*>")
_TAG = re.compile(r"</?[A-Za-z][^>]*>")
_BLANK = re.compile(r"[ \t\r\f\v ]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, url: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {kind}')}>"


class _Ends:
    """Where things end in a page.  What is not found after one place isn't looked for after a later one, so
    all searches together go over the page a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.none = page, set()

    def after(self, what, at: int) -> int:
        """End of the next ``what`` (a string, or the closing tag of an element), or -1."""
        if what in self.none:
            return -1
        if what in _CLOSING:
            m = _CLOSING[what].search(self.page, at)
            end = m.end() if m else -1
        else:
            end = self.page.find(what, at)
            end = end + len(what) if end >= 0 else -1
        if end < 0:
            self.none.add(what)
        return end

    def element(self, name: str, at: int) -> int:
        """End of the element whose tag's name ends at ``at``, or -1."""
        end = self.after(">", at)
        return self.after(name, end) if end >= 0 else -1


def _without(page: str, starts: re.Pattern, end_of) -> str:
    """The page with a space for each stretch from a start to ``end_of(ends, match)``; a start without an end stays."""
    ends, parts, at, m = _Ends(page), [], 0, starts.search(page)
    while m:
        end = end_of(ends, m)
        if end >= 0:
            parts += [page[at:m.start()], " "]
            at = end
        m = starts.search(page, max(end, m.start() + 1))
    return "".join([*parts, page[at:]])


def _hidden_end(ends: _Ends, m: re.Match) -> int:
    comment, name, _ = m.groups()
    if comment:
        return ends.after("-->", m.end())
    return ends.element(name.lower(), m.end()) if name else ends.after(">", m.end())


def shown(page: str) -> str:
    """The page without comments, doctype and elements whose content isn't text."""
    return _without(page, _HIDDEN, _hidden_end)


def visible_text(page: str) -> str:
    """Text of a page: a line per block, white space collapsed, entities resolved."""
    body = _without(shown(page), _HEAD, lambda ends, m: ends.element("head", m.end()))
    last = body.rfind(">") + 1                    # beyond it no tag ends
    text = _TAG.sub("", _BLOCK.sub("\n", body[:last])) + body[last:]
    return _LINES.sub("\n", _BLANK.sub(" ", entities.unescape(text))).strip()


def _title(page: str) -> str | None:
    ends, m = _Ends(page), _TITLE.search(page)
    first = ends.after(">", m.end()) if m else -1
    end = ends.after("title", first) if first >= 0 else -1
    return page[first:page.rindex("<", first, end)] if end >= 0 else None


def _tags(page: str, start: re.Pattern) -> Iterator[tuple[int, int]]:
    """(end of the name, end of the tag or the page) of tags one after the other; the caller may send a later place to go on from."""
    ends, m = _Ends(page), start.search(page)
    while m:
        end = ends.after(">", m.end())
        end = end - 1 if end >= 0 else len(page)
        later = yield m.end(), end
        m = start.search(page, max(end, later or 0))


def _language(page: str) -> str | None:
    for at, end in _tags(page, _HTML):
        found = None
        for found in _LANG.finditer(page, at, end):
            pass
        if found:
            return found[1]
    return None


def links(page: str) -> list[str]:
    """The href values of the page's anchors: of each the last one that has a value."""
    out, tags, last = [], _tags(page, _ANCHOR), {q: page.rfind(q) for q in "\"'"}
    step = next(tags, None)
    while step:
        at, end = step
        later = None
        for m in reversed(list(_HREF.finditer(page, at, end))):
            quote = page[m.end():m.end() + 1]
            if quote and quote in "\"'" and last[quote] > m.end():
                later = page.index(quote, m.end() + 1) + 1
                out.append(page[m.end() + 1:later - 1])
            elif value := _BARE.match(page, m.end()):
                out.append(value[0])
                later = value.end()
            if later:
                break
        try:
            step = tags.send(later)
        except StopIteration:
            step = None
    return out


def metadata_fields(page: str, http: list[str]) -> list[tuple[str, str]]:
    """Source headers, title, language and links of a page."""
    title, lang = _title(page), _language(page)
    clean = lambda s: " ".join(entities.unescape(s).split())
    fields = [("http-status", http[0])] + [("http-header", h) for h in http[1:]]
    if title is not None:
        fields.append(("title", clean(title)))
    if lang:
        fields.append(("language", lang))
    return fields + [("outlink", clean(link)) for link in links(shown(page))]


def _records(columns: dict[str, list], page_id: pa.Array) -> pa.RecordBatch:
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = {"block": pa.binary(), "page_id": pa.int64()}
    return pa.record_batch([page_id if n == "page_id" else pa.array(columns[n], types.get(n, pa.string())) for n in names],
                           names=names)


_FIELDS = [c.split()[0] for c in RECORD.split(", ")][1:]


def _made(rows: list[tuple], page_id: pa.Array) -> pa.RecordBatch:
    return _records(dict(zip(_FIELDS, zip(*rows))) if rows else {n: [] for n in _FIELDS}, page_id)


def responses(pages: DataFrame) -> DataFrame:
    """One response record per row of page_id, url, html."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page_id, url, page in zip(*(c.to_pylist() for c in b.columns)):
                url, body = url or "", (page or "").encode()
                block = "\r\n".join([*HTTP, f"Content-Length: {len(body)}", "", ""]).encode() + body
                rows.append(("response", record_id(page_id, url, "response"), None, url, DATE,
                             "application/http; msgtype=response", digest(block), digest(body), block))
            yield _made(rows, b.column(0))

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, RECORD)


def derive(records: DataFrame) -> DataFrame:
    """The response records and, for each, its metadata and conversion record.  A body is read as UTF-8; bytes that
    aren't are replaced in the derivatives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page_id, *r in zip(*(c.to_pylist() for c in b.columns)):
                rows.append(tuple(r))
                _, source, _, url, date, _, _, payload, block = r
                head, _, body = block.partition(b"\r\n\r\n")
                page = body.decode("utf-8", "replace")
                fields = metadata_fields(page, head.decode("utf-8", "replace").split("\r\n"))
                meta = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("source-payload-digest", payload)])
                for kind, content_type, made in (("metadata", "application/warc-fields", meta),
                                                 ("conversion", "text/plain; charset=utf-8", visible_text(page))):
                    made = made.encode("utf-8", "replace")
                    rows.append((kind, record_id(page_id, url, kind), source, url, date, content_type, digest(made), digest(made), made))
            yield _made(rows, b.column(0).take(pa.array([k for k in range(b.num_rows) for _ in range(3)], pa.int64())))

    return records.where("kind = 'response'").select("page_id", *_FIELDS).mapInArrow(run, RECORD)


def _headers() -> F.Column:
    line = lambda name, col: F.when(col.isNotNull(), F.concat(F.lit(f"{name}: "), col, F.lit("\r\n"))).otherwise("")
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("kind")), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")), line("WARC-Target-URI", F.col("url")), line("WARC-Date", F.col("date")),
        line("X-Page-ID", F.col("page_id").cast("string")), line("Content-Type", F.col("content_type")),
        line("WARC-Block-Digest", F.col("block_digest")), line("WARC-Payload-Digest", F.col("payload_digest")),
        line("Content-Length", F.octet_length("block").cast("string")))


def write_warc(records: DataFrame, path: str, records_per_file: int = 100_000) -> None:
    """WARC files of gzip members, one for each record, so that a reader can begin at any record.

    The text sink writes the members' bytes as they are; its line separator is an empty member.
    """
    import gzip

    whole = F.concat(_headers().cast("binary"), F.lit("\r\n").cast("binary"), F.col("block"), F.lit("\r\n\r\n").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for b in batches:
            yield pa.record_batch([pa.array([gzip.compress(r, 6, mtime=0) for r in b.column(0).to_pylist()], pa.binary())], names=["member"])

    (records.select(whole.alias("record")).mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value")).write
     .option("lineSep", gzip.compress(b"", 6, mtime=0).decode("latin-1")).option("encoding", "ISO-8859-1")
     .option("maxRecordsPerFile", records_per_file).text(path))
    sc = records.sparkSession.sparkContext
    top = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(sc._jsc.hadoopConfiguration())
    for status in fs.listStatus(top):             # a file or a few a task
        name = status.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(status.getPath(), sc._jvm.org.apache.hadoop.fs.Path(top, name.removesuffix(".txt") + ".warc.gz"))


#: Bytes read at a time.
CHUNK = 1 << 20


def records_of(stream) -> Iterator[tuple]:
    """(page_id, fields of RECORD) of the records of a binary stream, gzipped (members one after the other) or plain, read in
    chunks: one record is held at a time.  A record without Content-Length reaches to the next one."""
    import zlib

    def plain() -> Iterator[bytes]:
        chunk = stream.read(CHUNK)
        if chunk[:2] != b"\x1f\x8b":
            while chunk:
                yield chunk
                chunk = stream.read(CHUNK)
            return
        member = zlib.decompressobj(31)
        while chunk:
            yield member.decompress(chunk)
            chunk = member.unused_data if member.eof else b""
            if member.eof:
                member = zlib.decompressobj(31)
            chunk = chunk or stream.read(CHUNK)

    parts, held, at = plain(), bytearray(), 0

    def more() -> bool:
        nonlocal held, at
        for part in parts:
            if part:
                held = held[at:] + part
                at = 0
                return True
        return False

    def line() -> bytes:
        nonlocal at
        seen = at
        while (end := held.find(b"\n", seen)) < 0:
            seen = len(held) - at
            if not more():
                rest, at = bytes(held[at:]), len(held)
                return rest
        out, at = bytes(held[at:end + 1]), end + 1
        return out

    def block(n: int) -> bytes:
        nonlocal at
        got = [bytes(held[at:at + n])]
        n -= len(got[0])
        at += len(got[0])
        while n > 0 and more():
            got.append(bytes(held[:n]))
            n -= len(got[-1])
            at = len(got[-1])
        return b"".join(got)

    ahead = line()
    while ahead:
        if not ahead.startswith(b"WARC/"):
            ahead = line()
            continue
        head = {}
        while (text := line().decode("utf-8", "replace").rstrip("\r\n")):
            name, _, value = text.partition(":")
            head[name.strip().lower()] = value.strip()
        if head.get("content-length", "").isdigit():
            body, ahead = block(int(head["content-length"])), line()
        else:
            body = bytearray()
            while (ahead := line()) and not ahead.startswith(b"WARC/"):
                body += ahead
            body = bytes(body).rstrip(b"\r\n")
        own = head.get("x-page-id", "")
        yield (int(own) if own.lstrip("-").isdigit() else None, head.get("warc-type"), head.get("warc-record-id"),
               head.get("warc-refers-to"), head.get("warc-target-uri", ""), head.get("warc-date"), head.get("content-type"),
               head.get("warc-block-digest"), head.get("warc-payload-digest"), body)


class _Chunks:
    """A stream of given chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks = iter(chunks)

    def read(self, _: int) -> bytes:
        return next(self.chunks, b"")


def _batches(records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for r in records:
        rows.append(r)
        size += len(r[-1])
        if len(rows) == 1000 or size > 16 * CHUNK:
            yield _made([r[1:] for r in rows], pa.array([r[0] for r in rows], pa.int64()))
            rows, size = [], 0
    yield _made([r[1:] for r in rows], pa.array([r[0] for r in rows], pa.int64()))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files under ``path``, in any store that Spark reads.

    Gzipped files (``*.gz``, one or many members) are read as a stream: Spark unpacks them and gives their lines in order, which
    a task puts together again, holding one record at a time.  Other files are read whole, 2 GB at most.
    """
    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks():
            for b in batches:
                lines, files = b.column(0).to_pylist(), b.column(1).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(files)) + 1).tolist(), len(lines)]
                for at, to in zip(edges, edges[1:]):
                    if at < to:
                        yield files[at], b"\n".join(lines[at:to]) + b"\n"

        for _, of_file in itertools.groupby(chunks(), key=lambda c: c[0]):
            yield from _batches(records_of(_Chunks(c for _, c in of_file)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                yield from _batches(records_of(_Chunks([content.as_py()])))

    every = spark.read.option("recursiveFileLookup", "true")
    lines = every.option("pathGlobFilter", "*.gz").option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"))
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .where("path not like '%.gz' and path not like '%.crc'").select("content"))
    return lines.mapInArrow(streamed, RECORD).unionAll(files.mapInArrow(whole, RECORD))


def query(pages: DataFrame) -> DataFrame:
    """All records of all pages, blocks as length and SHA-256."""
    return derive(responses(pages)).select(
        "page_id", "kind", "record_id", "refers_to", "url", "content_type", "block_digest", "payload_digest",
        F.octet_length("block").cast("bigint").alias("block_bytes"), F.sha2("block", 256).alias("block_sha256"))
