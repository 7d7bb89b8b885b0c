"""WARC records in ZIP archives: a writer that stores members, and a reader of central directories, indexes and ranges.

An archive is a ZIP file of stored (uncompressed) members: data.warc.gz, with one gzip member for each record, and
index.cdxj, with one line for each record that gives its offset and length in the WARC member. The reader finds the end record
(and the ZIP64 one, if sizes, counts or offsets need it), parses the central directory, locates the members behind
their local headers and then reads the index and single records by byte ranges. Nothing is extracted.

Paths may be local, file:, or any URI that pyarrow's file systems know. Files are written under a name of their own
and renamed when they are whole, so a task that is run again after a lost executor replaces what it had left.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .arrow import slices
from .store import Scratch

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
SMALL = 100  # payloads below this many bytes are never revisits
_LOCAL, _CENTRAL, _END, _END64, _AT64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_MOST = 0xFFFFFFFF


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path there; file: URIs may have one slash or three."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class ZipWriter:
    """Writes stored members one after the other to a stream; ZIP64 records where a value needs them, or always."""

    def __init__(self, out, always64: bool = False):
        self.out, self.always64, self.at, self.entries = out, always64, 0, []

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def begin(self, name: str) -> None:
        """A member of unknown size: its local header has ZIP64 sizes in a data descriptor behind the data."""
        self.name, self.start, self.crc = name.encode(), self.at, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<4s5H3I2H", _LOCAL, 45, 0x0808, 0, 0, 0x21, 0, _MOST, _MOST, len(self.name), len(extra)) + self.name + extra)
        self.data = self.at

    def write(self, raw: bytes) -> None:
        self.crc = zlib.crc32(raw, self.crc)
        self._put(raw)

    def end(self) -> None:
        size = self.at - self.data
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", self.crc, size, size))
        self.entries.append((self.name, self.crc, size, self.start))

    def close(self) -> None:
        first = self.at
        for name, crc, size, start in self.entries:
            wide = self.always64 or max(size, start) >= _MOST
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start) if wide else b""
            s, o = (_MOST, _MOST) if wide else (size, start)
            self._put(struct.pack("<4s6H3I5H2I", _CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, s, s, len(name), len(extra), 0, 0, 0, 0, o) + name + extra)
        size, n = self.at - first, len(self.entries)
        wide = self.always64 or max(size, first) >= _MOST or n >= 0xFFFF
        if wide:
            here = self.at
            self._put(struct.pack("<4sQ2H2I4Q", _END64, 44, 45, 45, 0, 0, n, n, size, first) + struct.pack("<4sIQI", _AT64, 0, here, 1))
        few, s, o = (0xFFFF, _MOST, _MOST) if wide else (n, size, first)
        self._put(struct.pack("<4s4H2IH", _END, 0, 0, few, few, s, o, 0))


class ZipReader:
    """Members of a ZIP file by ranged reads. members: name to (method, stored size, size, offset of the local header)."""

    def __init__(self, source):
        self.source, self.size = source, source.size() if hasattr(source, "size") else source.seek(0, io.SEEK_END)
        tail_at = max(0, self.size - 65557)  # the end record and the longest comment
        tail = self.range(tail_at, self.size - tail_at)
        at = tail.rfind(_END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(_END, 0, at)  # the signature stood in a comment
        if at < 0:
            raise ValueError("not a ZIP file: no end of central directory")
        count, size, first = struct.unpack_from("<HII", tail, at + 10)
        if count == 0xFFFF or size == _MOST or first == _MOST:
            locator = self.range(tail_at + at - 20, 20)
            if locator[:4] != _AT64:
                raise ValueError("ZIP64 end of central directory isn't located")
            end = self.range(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end[:4] != _END64:
                raise ValueError("no ZIP64 end of central directory")
            count, size, first = struct.unpack_from("<QQQ", end, 32)
        self.members = self._directory(self.range(first, size), count)

    def range(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        raw = self.source.read(length)
        if len(raw) != length:
            raise ValueError(f"truncated: {length} bytes at {start} wanted, {len(raw)} there")
        return raw

    @staticmethod
    def _directory(raw: bytes, count: int) -> dict[str, tuple[int, int, int, int]]:
        members, at = {}, 0
        for _ in range(count):
            if raw[at : at + 4] != _CENTRAL:
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            stored, size, n, m, k = struct.unpack_from("<IIHHH", raw, at + 20)
            offset = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = raw[at + 46 + n : at + 46 + n + m], 0
            while e + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, e)
                if kind == 1:  # 64-bit values, in this order, of the fields that are full
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, e + 4))
                    size = next(wide) if size == _MOST else size
                    stored = next(wide) if stored == _MOST else stored
                    offset = next(wide) if offset == _MOST else offset
                e += 4 + length
            members[name] = (method, stored, size, offset)
            at += 46 + n + m + k
        return members

    def locate(self, name: str) -> tuple[int, int]:
        """Where a stored member's data begin in the file, and their length."""
        method, stored, _, offset = self.members[name]
        if method != 0:
            raise ValueError(f"{name} isn't stored but compressed by method {method}")
        head = self.range(offset, 30)
        if head[:4] != _LOCAL:
            raise ValueError(f"no local header of {name}")
        n, m = struct.unpack_from("<HH", head, 26)
        return offset + 30 + n + m, stored

    def member_range(self, name: str, start: int, length: int) -> bytes:
        at, size = self.locate(name)
        if start + length > size:
            raise ValueError(f"range beyond {name}")
        return self.range(at + start, length)


def record(kind: str, uri: str, payload: bytes, headers: dict[str, str]) -> bytes:
    """One WARC record, as a gzip member; the block is an HTTP response."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    fields = {"WARC-Type": kind, "WARC-Target-URI": uri, "Content-Type": "application/http; msgtype=response", **headers, "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 3, mtime=0)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one gzipped WARC record."""
    raw = gzip.decompress(raw)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]):
        raise ValueError("truncated WARC record")
    return headers, block.partition(b"\r\n\r\n")[2]


def _uri(url: str | None) -> str:
    """A URL on one header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "urn:none")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages(page_id, url, html, digest, kind, refers) to one archive per partition; (archive, records) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        system, base = filesystem(folder)
        system.create_dir(base, recursive=True)
        name, temporary = f"{base}/pages-{part:05d}.wacz", f"{base}/.{uuid.uuid4().hex}"
        n, index, z, out = 0, [], None, None
        try:
            for batch in slices(batches, "html"):
                for row in batch.to_pylist():
                    if z is None:
                        out = system.open_output_stream(temporary)
                        z = ZipWriter(out)
                        z.begin(DATA)
                    payload = (row["html"] or "").encode()
                    headers = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{part}/{n}')}>", "WARC-Payload-Digest": "sha256:" + base64.b32encode(bytes.fromhex(row["digest"])).decode(), "X-Page-Id": json.dumps(row["page_id"]), "X-Payload-Length": str(len(payload))}
                    if row["kind"] == "revisit":
                        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-Id": str(row["refers"])}
                        payload = b""
                    raw = record(row["kind"], _uri(row["url"]), payload, headers)
                    index.append(json.dumps({"offset": z.at - z.data, "length": len(raw), "page_id": row["page_id"], "type": row["kind"]}))
                    z.write(raw)
                    n += 1
            if z is not None:
                z.end()
                z.begin(INDEX)
                z.write("".join(f"{line}\n" for line in index).encode())
                z.end()
                z.close()
                out.close()
                system.move(temporary, name)
                yield pa.record_batch([pa.array([f"{folder}/{os.path.basename(name)}"]), pa.array([n], pa.int64())], ["archive", "records"])
        except BaseException:
            if out is not None:
                out.close()
                system.delete_file(temporary)
            raise

    return pages.select("page_id", "url", "html", "digest", "kind", "refers").mapInArrow(run, "archive string, records long")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def read(archives: DataFrame) -> DataFrame:
    """The records of archives(archive), by range reads; a response's digest is computed from its payload and checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                system, name = filesystem(path)
                with system.open_input_file(name) as source:
                    z = ZipReader(source)
                    data, _ = z.locate(DATA)
                    rows: list[tuple] = []
                    for line in z.member_range(INDEX, 0, z.members[INDEX][1]).splitlines():
                        entry = json.loads(line)
                        headers, payload = parse(z.range(data + entry["offset"], entry["length"]))
                        digest, kind = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha256:")).hex(), headers["WARC-Type"]
                        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(headers["X-Payload-Length"])):
                            raise ValueError(f"payload of {entry} doesn't match its digest")
                        refers = headers.get("X-Refers-To-Page-Id")
                        rows.append((json.loads(headers["X-Page-Id"]), int(headers["X-Payload-Length"]), digest, kind, int(refers) if refers else None, path, entry["offset"], entry["length"]))
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows.clear()
                    yield _batch(rows)

    return archives.select("archive").mapInArrow(run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in RECORDS.split(", ")])


def deduplicated(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with digest, kind and refers: of equal payloads of SMALL bytes and more the smallest page_id is the response.

    Rows without a page_id are responses. A page_id that stands several times with one payload is one response more
    than once, as a record can't revisit itself.
    """
    pages = pages.select("page_id", "url", "html").withColumn("digest", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= SMALL
    first = pages.where(large & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    first = first.where("first < last").select("digest", "first")  # only payloads that stand on several pages
    joined = pages.hint("merge").join(first, "digest", "left")
    again = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False)) & large
    return joined.select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers"))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back: one row per row of pages(page_id, url, html).

    A null html is an empty payload and a null url stands as urn:none. Records are written row by row, so repeated rows
    come back as often; an empty table writes no archive and gives an empty result; further columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    written = scratch.save(write(deduplicated(pages), scratch.path("archives")), "written")
    spread = written.repartition(pages.sparkSession.sparkContext.defaultParallelism * 2, "archive")
    return read(spread)
