"""WARC archives: one gzip member per record, written from a table and read back sequentially.

The reader inflates a stream chunk by chunk (zlib, incremental), frames each record by its Content-Length while it is being
inflated, starts anew at each member and verifies block and payload digests, so its memory follows its chunk size and the
largest record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, staged

#: Fixed values of the WARC 1.1 format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes read at once.
CHUNK = 1 << 20
#: An archive is closed, and the next begun, once it has so many bytes.
ARCHIVE_BYTES = 256 << 20


class WarcError(ValueError):
    """A record that isn't framed as the format says, or whose digest is wrong."""


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _base32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def digest(data: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return _base32(hashlib.sha1(data).digest())


def one_line(value: str) -> str:
    """A header value: line ends and controls can't stand in it."""
    return "".join(c if c >= " " else "%%%02X" % ord(c) for c in value)


def encode_record(page_id: str, url: str, payload: bytes, payload_digest: str, refers_to: str | None) -> bytes:
    """One gzip member. A revisit has the HTTP head alone; its Content-Length there is that of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:x-page:{page_id}>",
        "WARC-Target-URI": one_line(url),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:x-page:{refers_to}>"}
    text = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return gzip.compress(f"{VERSION}\r\n{text}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", 6, mtime=0)


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode().split("\r\n")
    return first, dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines if x)


class _Frame:
    """A record as its bytes come in: the header up to an empty line, a block of Content-Length bytes, digested as they
    pass, and two line ends."""

    def __init__(self) -> None:
        self.top, self.headers, self.left = bytearray(), None, 0
        self.http_top, self.http = bytearray(), None
        self.block, self.told, self.payload, self.tail = hashlib.sha1(), hashlib.sha1(), bytearray(), b""

    def fail(self, why: str) -> WarcError:
        return WarcError(f"{(self.headers or {}).get('WARC-Record-ID')}: {why}")

    @staticmethod
    def _head(held: bytearray, data: bytes) -> tuple[str, dict[str, str], bytes] | None:
        """Fields and what follows them, once the empty line has come."""
        begin = max(0, len(held) - 3)
        held += data
        at = held.find(b"\r\n\r\n", begin)
        return None if at < 0 else (*_fields(bytes(held[:at])), bytes(held[at + 4 :]))

    def take(self, data: bytes) -> None:
        if self.headers is None:
            if (found := self._head(self.top, data)) is None:
                return
            version, self.headers, data = found
            self.left = int(self.headers.get("Content-Length", -1))
            if not version.startswith("WARC/") or self.left < 0:
                raise WarcError("no WARC header")
        part, rest = data[: self.left], data[self.left :]
        self.left -= len(part)
        self.tail += rest
        if len(self.tail) > 4:
            raise self.fail("the block is longer than Content-Length says")
        self.block.update(part)
        if self.http is None:
            if (found := self._head(self.http_top, part)) is None:
                return
            _, self.http, part = found
        self.told.update(part)
        self.payload += part

    def record(self) -> Record:
        if self.headers is None or self.http is None:
            raise WarcError("no WARC header")
        if self.left or self.tail != b"\r\n\r\n":
            raise self.fail("the block isn't as long as Content-Length says")
        if self.headers.get("WARC-Block-Digest", "") != f"sha1:{_base32(self.block.digest())}":
            raise self.fail("wrong block digest")
        if self.headers["WARC-Type"] == "response" and (int(self.http["Content-Length"]) != len(self.payload) or self.headers["WARC-Payload-Digest"] != f"sha1:{_base32(self.told.digest())}"):
            raise self.fail("wrong payload length or digest")
        return Record(self.headers, self.http, bytes(self.payload))


def read_records(read: Callable[[int], bytes]) -> Iterator[Record]:
    """Records of one archive in order. read(n) gives up to n bytes more, none at the end. Members are inflated at most
    CHUNK bytes at a time, so besides a chunk only the record that is being framed is held."""
    data = read(CHUNK)
    while data:
        member, frame = zlib.decompressobj(31), _Frame()
        while not member.eof:
            out = member.decompress(data, CHUNK)
            frame.take(out)
            data = member.unconsumed_tail
            if not member.eof and not data and len(out) < CHUNK and not (data := read(CHUNK)):
                raise WarcError("the archive ends inside a record")
        yield frame.record()
        data = member.unused_data or read(CHUNK)


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes a record per row to archives under the folder out, which all executors reach; returns the manifest
    (path, n_records, n_bytes).

    Of rows with equal payloads (null: empty) those with the largest key are responses, the others revisit it. A payload
    crosses the network once, dealt by its digest with Spark's skew join for hot ones; what decides is a digest and a
    number for each payload. Each attempt of a task writes files of its own name; only files in the manifest, which
    Spark commits, count, so lost executors leave at most unused files. Null keys sort first and are written as such;
    of rows with equal keys and payloads all with the largest key are responses."""
    rows = pages.select(
        F.col(key).cast("long").alias("id"),
        F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("body"),
    ).withColumn("sha", F.sha1(F.col("body").cast("binary")))
    first = rows.groupBy("sha").agg(F.max("id").alias("first"))
    joined = rows.join(first, "sha", "left").select("id", "url", "body", "sha", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(out)
        store.create_dir(folder, recursive=True)
        where, done = TaskContext.get(), []
        path, file, n, size = "", None, 0, 0

        def close() -> None:
            if file is not None:
                file.close()
                done.append((path, n, size))

        for b in batches:
            for i, u, body, sha, first in zip(*(b.column(c) for c in ("id", "url", "body", "sha", "first")), strict=True):
                if file is None or size >= ARCHIVE_BYTES:
                    close()
                    path = f"{out}/{where.partitionId():05d}-{where.taskAttemptId()}-{len(done):03d}.warc.gz"
                    file, n, size = store.open_output_stream(f"{folder}/{path.rpartition('/')[2]}"), 0, 0
                i, first, raw = i.as_py(), first.as_py(), body.as_py().encode()
                member = encode_record("" if i is None else str(i), u.as_py(), raw, _base32(bytes.fromhex(sha.as_py())), None if i == first else str(first))
                file.write(member)
                n, size = n + 1, size + len(member)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "n_records", "n_bytes"])

    return joined.mapInArrow(write, "path string, n_records long, n_bytes long")


def read_archives(manifest: DataFrame, files: int) -> DataFrame:
    """A row per record of the archives in the manifest: page_id, payload_bytes, payload_digest, record_type, refers_to,
    url, payload (null for revisits). files: tasks over which archives are dealt."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def number(uri: str | None) -> int | None:
        tail = (uri or "").rstrip(">").rpartition(":")[2]
        return int(tail) if tail else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                store, at = _store(path)
                rows, mass = [], 0
                with store.open_input_stream(at) as f:
                    for r in read_records(f.read):
                        kind = r.headers["WARC-Type"]
                        rows.append((number(r.headers["WARC-Record-ID"]), int(r.http["Content-Length"]), r.headers["WARC-Payload-Digest"].removeprefix("sha1:"), kind, number(r.headers.get("WARC-Refers-To")), r.headers["WARC-Target-URI"], r.payload.decode() if kind == "response" else None))
                        mass += len(r.payload)
                        if mass > 8 * CHUNK or len(rows) == 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, mass = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return manifest.select("path").repartition(max(1, files)).mapInArrow(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives to a new folder in the shared one and reads them back; the digest columns of each record."""
    out = new_path(pages.sparkSession, "warc")
    manifest = staged(write_archives(pages, out), "warc-manifest")
    return read_archives(manifest, manifest.count()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
