"""WARC archives: a writer with payload deduplication, and a sequential reader.

One gzip member holds one record. The reader decompresses incrementally, frames the block by its
Content-Length and checks the payload digest while it reads, so without payloads its memory does not
depend on the size of a record. A damaged member gives a row with an error, and reading goes on at the
next member that can be found.

At scale: files are written by the tasks to a folder all executors share, under names that no other
attempt uses, and the manifest lists the files of the attempts that succeeded alone; what lost or
repeated attempts left behind is never read. Files are read in parallel, one task each. The record
that others refer to is found by an aggregate of (digest, page_id), pre-aggregated before it is
shuffled; a payload that a third of all pages share is a skewed join key, which adaptive execution splits.

Defined results: a null payload is empty; a null URL gives no target URI; a null page_id is below all
others, and reads back as null. Rows that repeat the largest page_id of their payload are responses
too. Line breaks in a URL are percent-encoded. An empty table gives no files and an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 18


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """An uncompressed record. A revisit has the HTTP head alone, with the length of the payload it leaves out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if revisit:
        fields += [("WARC-Refers-To", _record_id(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in fields), b"", b""]) + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


@dataclass
class Record:
    fields: dict
    payload: bytes | None
    payload_bytes: int
    payload_digest: str
    error: str | None = None

    @property
    def kind(self) -> str | None:
        return self.fields.get("warc-type")


class _Parser:
    """Takes a record's bytes as they are decompressed: WARC head, then Content-Length bytes (HTTP head, payload), then the end."""

    def __init__(self, keep: bool):
        self.head, self.fields, self.left, self.http, self.tail = bytearray(), None, 0, None, bytearray()
        self.sha, self.block_sha, self.n, self.payload = hashlib.sha1(), hashlib.sha1(), 0, bytearray() if keep else None

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = bytes(self.head[:end]).decode("utf-8", "surrogatepass").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("no WARC version line")
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            data, self.head = bytes(self.head[end + 4 :]), bytearray()
            self.left = int(self.fields["content-length"])
        block, rest = data[: self.left], data[self.left :]
        self.left -= len(block)
        self.block_sha.update(block)
        if self.http is None and block:
            self.head += block
            end = self.head.find(b"\r\n\r\n")
            block = b""
            if end >= 0:
                self.http, block, self.head = bytes(self.head[:end]), bytes(self.head[end + 4 :]), bytearray()
        self.n += len(block)
        self.sha.update(block)
        if self.payload is not None:
            self.payload += block
        self.tail += rest
        if len(self.tail) > 4:
            raise ValueError("more bytes than Content-Length says")

    def end(self) -> Record:
        if self.fields is None:
            raise ValueError("no end of the WARC head")
        if self.left or self.tail != b"\r\n\r\n":
            raise ValueError("fewer bytes than Content-Length says")
        got = base64.b32encode(self.sha.digest()).decode()
        said = self.fields.get("warc-payload-digest", "").removeprefix("sha1:")
        error, n = None, self.n
        if self.fields.get("warc-block-digest", "sha1:" + base64.b32encode(self.block_sha.digest()).decode()).removeprefix("sha1:") != base64.b32encode(self.block_sha.digest()).decode():
            error = "block digest differs"
        if self.fields.get("warc-type") == "revisit":
            found = re.search(rb"(?i)^content-length:[ \t]*(\d+)", self.http or b"", re.M)
            n, got = int(found[1]) if found else 0, said
        elif said and said != got:
            error = "payload digest differs"
        return Record(self.fields, None if self.payload is None else bytes(self.payload), n, got, error)


def read_records(stream, keep_payload: bool = True) -> Iterator[Record]:
    """The records of an open archive, in order; stream needs read(n) only."""
    data, more = b"", True
    while True:
        if not data:
            data = stream.read(CHUNK)
            if not data:
                return
        inflate, parser, error = zlib.decompressobj(31), _Parser(keep_payload), None
        taken = data
        while not inflate.eof:
            try:
                out = inflate.decompress(data, CHUNK)
                data = inflate.unconsumed_tail
                if error is None:
                    parser.feed(out)
            except zlib.error as e:
                error = f"damaged member: {e}"
                break
            except (ValueError, KeyError) as e:
                error = f"damaged record: {e}"
            if not inflate.eof and not data and not out:
                data = stream.read(CHUNK)
                if not data:
                    error, more = error or "truncated member", False
                    break
                taken = data
        if inflate.eof:
            data = inflate.unused_data
        elif more:  # look for the next member after the first bytes of this one
            data = taken
            while (at := data.find(b"\x1f\x8b\x08", 1)) < 0:
                data = data[-2:] + (block := stream.read(CHUNK))
                if not block:
                    more, data = False, b""
                    break
            data = data[at:] if more else b""
        if error is None:
            try:
                yield parser.end()
            except ValueError as e:
                error = f"damaged record: {e}"
        if error is not None:
            yield Record(parser.fields or {}, None, parser.n, "", error)
        if not more:
            return


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def plan_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, revisit, refers_to: of equal payloads of min_bytes or more, the largest page_id stays a response."""
    body = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), body.alias("payload")).withColumn("sha", F.sha1("payload"))
    heads = rows.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("_top"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("sha").alias("_sha"), "_top")
    joined = rows.join(heads, F.col("sha") == F.col("_sha"), "left")
    revisit = F.col("_top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_top"))
    return joined.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("_top")).alias("refers_to"))


def write_archives(planned: DataFrame, folder: str, max_bytes: int = 1 << 28, level: int = 6) -> DataFrame:
    """Writes planned records to .warc.gz files of about max_bytes in a folder that all executors share. Returns the manifest: path, n_records, n_bytes."""
    names = ["path", "n_records", "n_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        stem = f"{root.rstrip('/')}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        out, done = None, []
        for b in batches:
            for i, u, p, r, t in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None:
                    path = f"{stem}-{len(done):03d}.warc.gz"
                    out, n, size = fs.open_output_stream(path, compression=None), 0, 0
                raw = member(record(i, u, p, t, r), level)
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= max_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=names)

    return materialize(planned.select("page_id", "url", "payload", "revisit", "refers_to").mapInArrow(run, "path string, n_records long, n_bytes long"))


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def read_archives(manifest: DataFrame, folder: str, keep_payload: bool = False) -> DataFrame:
    """A row a record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, error and, with keep_payload, payload."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"] + ["payload"] * keep_payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * keep_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream, keep_payload):
                        rows.append((_page(r.fields.get("warc-record-id")), r.fields.get("warc-target-uri"), r.payload_bytes, r.payload_digest, r.kind, _page(r.fields.get("warc-refers-to")), r.error, *[r.payload] * keep_payload))
                        held += len(r.payload or b"")
                        if len(rows) >= 10_000 or held > 1 << 25:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = max(1, manifest.count())
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, error string" + ", payload binary" * keep_payload
    return manifest.select("path").repartition(files).mapInArrow(run, schema)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, min_bytes: int = 0, keep_payload: bool = False) -> DataFrame:
    """Write, then read back."""
    folder = folder or fresh_path(spark, "warc")
    return read_archives(write_archives(plan_revisits(pages, min_bytes=min_bytes), folder), folder, keep_payload)
