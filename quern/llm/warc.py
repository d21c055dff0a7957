"""WARC archives as chunked record tables.

write_warc() writes one gzip member per record. read_chunks() streams archives and turns each record into
rows (record_id, chunk_no, data, n_bytes, digest, last): digest is the SHA-1 of the record's payload up
to and with that chunk, carried on from the chunk before, so neither side holds a whole record.

Of records with equal payloads of at least `revisit_bytes` bytes the smallest id is the response and the
others are revisits, which have no payload of their own and name the response. A record's block is an
HTTP response message, so its payload is what follows the HTTP headers, and a revisit keeps these headers.

Defined results: null html is an empty payload; rows that repeat both the smallest page_id and the
payload are all responses; a null page_id sorts after all others; null urls become urn:page:<id>;
extra columns are not read. Record ids name page_id, url and payload, so only rows that are equal in all
three share one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm._io import make_dir, open_fs, work_dir, written

BLOCK = 1 << 16
END = b"\r\n"
DATE = "2024-01-01T00:00:00Z"


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _member(out, head: list[tuple[str, str]], blocks) -> None:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    out.write(z.compress(text.encode()))
    for b in blocks:
        out.write(z.compress(b))
    out.write(z.compress(END + END) + z.flush())


def decide(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """dup (SHA-1, binary) of payloads that more than one row has, with page_id and mark of the response."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    prints = pages.select("page_id", "mark", F.unhex(F.sha1(payload)).alias("sha"), F.octet_length(payload).alias("n")).where(F.col("n") >= revisit_bytes)
    order = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "mark"))
    groups = prints.groupBy("sha").agg(order.alias("m"), F.count("*").alias("c")).where("c > 1")
    return written(groups.select(F.col("sha").alias("dup"), F.col("m.page_id").alias("keep_id"), F.col("m.mark").alias("keep_mark")), "payloads")


def write_warc(pages: DataFrame, *, revisit_bytes: int = 0) -> DataFrame:
    """Write the archives; returns their manifest (path, n_records). pages: page_id, url, html."""
    spark = pages.sparkSession
    where = make_dir(work_dir(spark, "warc"))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").withColumn("mark", F.lower(F.hex(F.xxhash64("url", "html"))))
    groups = decide(slim, revisit_bytes)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = slim.withColumn("sha", F.unhex(F.sha1(payload))).join(groups, F.col("sha") == F.col("dup"), "left")

    def name_of(page, mark: str) -> str:
        return f"<urn:page:{'' if page is None else page}:{mark}>"

    def write(batches):
        out, n, name = None, 0, uuid.uuid4().hex
        fs, path = open_fs(where)
        for x in batches:
            for page, url, html, sha, dup, keep, mark, keep_mark in zip(*(x.column(c) for c in ("page_id", "url", "html", "sha", "dup", "keep_id", "mark", "keep_mark")), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{path}/{name}.warc.gz", compression=None)
                    _member(out, [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Length", "0")], [])
                data = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
                page, keep = page.as_py(), keep.as_py()
                revisit = dup.is_valid and page != keep
                body = 0 if revisit else len(data)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
                head = [
                    ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name_of(page, mark.as_py())), ("WARC-Date", DATE),
                    ("WARC-Target-URI", (url.as_py() or f"urn:page:{page}").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{_b32(sha.as_py())}"),
                    *([("WARC-Refers-To", name_of(keep, keep_mark.as_py())), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if revisit else []),
                    ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http) + body)),
                ]
                _member(out, head, (http, *(data[s : s + BLOCK] for s in range(0, body, BLOCK))))
                n += 1
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([f"{where}/{name}.warc.gz"]), pa.array([n], pa.int64())], ["path", "n_records"])

    return written(rows.mapInArrow(write, "path string, n_records long"), "manifest")


class _Members:
    """The decompressed bytes of a .warc.gz as a stream, block by block."""

    def __init__(self, f):
        self.f, self.z, self.held, self.raw, self.done = f, zlib.decompressobj(31), b"", b"", False

    def more(self) -> bool:
        while not self.done:
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.f.read(BLOCK)
                if not self.raw:
                    self.done = True
                    return False
            got = self.z.decompress(self.raw, BLOCK)
            self.raw = self.z.unconsumed_tail
            if got:
                self.held += got
                return True
        return False

    def line(self) -> bytes | None:
        while (at := self.held.find(END)) < 0:
            if not self.more():
                return None
        out, self.held = self.held[:at], self.held[at + 2 :]
        return out

    def some(self, most: int) -> bytes:
        if not self.held and not self.more():
            raise EOFError("a record ends early")
        out, self.held = self.held[:most], self.held[most:]
        return out


def records(f):
    """(headers, iterator of payload chunks) for each record of an open archive; the iterator must be read to its end.

    The HTTP headers of a block are taken off; the message's Content-Length is given as `payload-length`.
    """
    m = _Members(f)
    while (line := m.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head = {}
        while line := m.line():
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()

        left = int(head["content-length"])
        if head.get("content-type", "").startswith("application/http"):
            while line := m.line():
                left -= len(line) + 2
                k, _, v = line.partition(b":")
                if k.strip().lower() == b"content-length":
                    head["payload-length"] = v.strip().decode()
            left -= 2

        def chunks(left=left):
            while left:
                got = m.some(min(left, BLOCK))
                left -= len(got)
                yield got

        head["block-left"] = str(left)
        yield head, chunks()


def read_chunks(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in a manifest. A record without payload has one chunk of no bytes."""

    def read(batches):
        names = ["record_id", "chunk_no", "data", "n_bytes", "digest", "last", "record_type", "refers_to", "payload_digest", "payload_length"]
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64()]
        rows, held = [], 0
        for x in batches:
            for uri in x.column("path").to_pylist():
                fs, path = open_fs(uri)
                with fs.open_input_stream(path, compression=None) as f:
                    for head, chunks in records(f):
                        if head["warc-type"] == "warcinfo":
                            continue
                        sha, no, seen, size = hashlib.sha1(), 0, 0, int(head["block-left"])
                        tail = (head["warc-type"], head.get("warc-refers-to"), head["warc-payload-digest"].removeprefix("sha1:"), int(head["payload-length"]))
                        for c in chunks if size else [b""]:
                            sha.update(c)
                            seen += len(c)
                            last = seen == size
                            rows.append((head["warc-record-id"], no, c if with_data else None, len(c), _b32(sha.digest()), last, *tail))
                            no, held = no + 1, held + (len(c) if with_data else 0) + 200
                            if held > 4 << 20:
                                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                                rows, held = [], 0
                        if tail[0] == "response" and (_b32(sha.digest()), seen) != tail[2:]:
                            raise ValueError(f"{uri}: {head['warc-record-id']} is damaged")
        if rows:
            yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kind = "record_id string, chunk_no int, data binary, n_bytes long, digest string, last boolean, record_type string, refers_to string, payload_digest string, payload_length long"
    n = max(1, manifest.count())
    return manifest.repartition(n, "path").mapInArrow(read, kind)


def read_records(manifest: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, n_chunks; from the last chunk of each."""
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]*):", 1).try_cast("long")
    return read_chunks(manifest, with_data=False).where("last").select(
        page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.when(F.col("record_type") == "response", F.col("digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"), (F.col("chunk_no") + 1).alias("n_chunks"),
    )
