"""WARC records inside ZIP packages: writing, and reading by byte ranges without extraction.

A package is a ZIP file of stored (uncompressed) members: ``archive/data.warc.gz``, in which each
record is a gzip member of its own, and ``indexes/index.cdxj``, one line per record with its offset
and length in the archive. The reader parses the end-of-central-directory record (and the ZIP64 one
when sizes or counts overflow), walks the central directory, resolves each stored member's data
offset from its local header, and then fetches index and records by range reads.
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
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, in_small_batches, keep, scratch_path

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
U32, U16 = 0xFFFFFFFF, 0xFFFF


# --- ZIP ---------------------------------------------------------------------------------------


class StoredZip:
    """Writes stored members in one forward pass; sizes and CRCs go to the central directory and a data descriptor."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.start, self.crc = name.encode(), self.at, 0
        # version 4.5, bit 3: sizes follow in the descriptor; method 0: stored
        self._put(struct.pack("<4s5H3L2H", b"PK\x03\x04", 45, 8 | 0x800, 0, 0, 0x21, 0, 0, 0, len(self.name), 0) + self.name)
        self.data = self.at

    def write(self, data: bytes) -> int:
        """Appends to the open member; returns where in the member it begins."""
        where = self.at - self.data
        self.crc = zlib.crc32(data, self.crc)
        self._put(data)
        return where

    def end(self) -> None:
        size = self.at - self.data
        self._put(struct.pack("<4sL", b"PK\x07\x08", self.crc) + (struct.pack("<QQ", size, size) if size > U32 else struct.pack("<LL", size, size)))
        self.members.append((self.name, self.crc, size, self.start))

    def close(self) -> None:
        begin = self.at
        for name, crc, size, start in self.members:
            wide = self.zip64 or size > U32 or start > U32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start) if wide else b""
            s, o = (U32, U32) if wide else (size, start)
            self._put(struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 45, 45, 8 | 0x800, 0, 0, 0x21, crc, s, s, len(name), len(extra), 0, 0, 0, 0, o) + name + extra)
        length, count = self.at - begin, len(self.members)
        if self.zip64 or begin > U32 or length > U32 or count > U16:
            end64 = self.at
            self._put(struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, length, begin))
            self._put(struct.pack("<4sLQL", b"PK\x06\x07", 0, end64, 1))
            self._put(struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, U16, U16, U32, U32, 0))
        else:
            self._put(struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, count, count, length, begin, 0))


def read_range(f, at: int, length: int) -> bytes:
    f.seek(at)
    data = f.read(length)
    if len(data) != length:
        raise ValueError(f"range {at}+{length} lies outside the package")
    return data


def zip_members(f, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (data offset, size) of the stored members, from central and ZIP64 directories."""
    tail_at = max(0, size - 65_557)
    tail = read_range(f, tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and len(tail) - at >= 22 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    count, length, begin = struct.unpack_from("<H2L", tail, at + 10)
    if count == U16 or length == U32 or begin == U32:
        locator = read_range(f, tail_at + at - 20, 20)
        if locator[:4] == b"PK\x06\x07":
            end64 = read_range(f, struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("ZIP64 end of central directory is damaged")
            count, length, begin = struct.unpack_from("<3Q", end64, 32)
    directory, p, found = read_range(f, begin, length), 0, {}
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("central directory is damaged")
        method, = struct.unpack_from("<H", directory, p + 10)
        packed, whole, n, m, k = struct.unpack_from("<2L3H", directory, p + 20)
        start, = struct.unpack_from("<L", directory, p + 42)
        name, extra = directory[p + 46 : p + 46 + n].decode("utf-8", "replace"), directory[p + 46 + n : p + 46 + n + m]
        while len(extra) >= 4:
            kind, size_of = struct.unpack_from("<2H", extra)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{size_of // 8}Q", extra, 4))
                whole = wide.pop(0) if whole == U32 else whole
                packed = wide.pop(0) if packed == U32 else packed
                start = wide.pop(0) if start == U32 else start
            extra = extra[4 + size_of :]
        if method == 0:
            local = read_range(f, start, 30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError(f"local header of {name} is damaged")
            found[name] = (start + 30 + sum(struct.unpack_from("<2H", local, 26)), packed)
        p += 46 + n + m + k
    return found


# --- WARC --------------------------------------------------------------------------------------


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member: the WARC header block, and the payload of a response; a revisit names its original instead."""
    uri = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("WARC block is cut short")
    return fields, rest[:n]


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The shared store of a URI or plain path."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


# --- operators ---------------------------------------------------------------------------------


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, sha: null html is an empty payload."""
    body = F.coalesce(in_small_batches(pages)["html"].cast("string"), F.lit("")).cast("binary")
    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), body.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))


def with_originals(pages: DataFrame) -> DataFrame:
    """Adds ``original``: the largest page_id of the payload where several rows share it, else null.

    Payload groups are pre-aggregated to one row; only digests that repeat meet the pages again, in a
    join that Spark may split when one digest is hot.
    """
    rows = payloads(pages)
    repeated = keep(rows.groupBy("sha").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "original"), "warc-originals")
    return rows.join(repeated, "sha", "left")


def write_packages(pages: DataFrame, folder: str, *, zip64: bool = False) -> DataFrame:
    """Writes one package per task under ``folder`` (which all executors must see); returns path, size and records.

    Repeated page_ids each give a record; among equal payloads the largest page_id is the response (its
    repeats too), the others revisit it. A null page_id never is the original unless alone. File names are unique to the attempt,
    and only those of tasks that ended are listed, so retried tasks leave no double records.
    """

    def write(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
        fs, root = store_of(folder)
        package = None
        for batch in stream:
            for page_id, url, payload, sha, original in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "payload", "sha", "original"))):
                if package is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/{name}")
                    package, index, count = StoredZip(sink, zip64), io.StringIO(), 0
                    package.begin(ARCHIVE)
                digest = base64.b32encode(sha).decode()
                revisit = original is not None and original != page_id
                data = record_bytes(page_id, url, payload, digest, original if revisit else None, revisit)
                where = package.write(data)
                index.write(json.dumps({"page": page_id, "offset": where, "length": len(data)}) + "\n")
                count += 1
        if package is not None:
            package.end()
            package.begin(INDEX)
            package.write(index.getvalue().encode())
            package.end()
            package.close()
            sink.close()
            yield from batches([(os.path.join(folder, name), package.at, count)], schema)

    return with_originals(pages).mapInArrow(write, "path string, bytes long, records long")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_ranges(packages: DataFrame, batch_bytes: int = 4_000_000) -> DataFrame:
    """path, at, ranges: runs of neighbouring records of bounded size, from each package's own index."""

    def locate(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("lengths", pa.list_(pa.int64()))])

        def rows():
            for batch in stream:
                for path in batch.column("path").to_pylist():
                    fs, name = store_of(path)
                    with fs.open_input_file(name) as f:
                        members = zip_members(f, f.size())
                        data, _ = members[ARCHIVE]
                        entries = [json.loads(x) for x in read_range(f, *members[INDEX]).splitlines()]
                    begin, lengths = None, []
                    for e in entries:
                        if begin is not None and (sum(lengths) >= batch_bytes or begin + sum(lengths) != data + e["offset"]):
                            yield path, begin, lengths
                            begin, lengths = None, []
                        begin = data + e["offset"] if begin is None else begin
                        lengths.append(e["length"])
                    if lengths:
                        yield path, begin, lengths

        yield from batches(rows(), schema)

    return packages.select("path").mapInArrow(locate, "path string, at long, lengths array<long>")


def read_packages(packages: DataFrame, *, payload: bool = True, partitions: int | None = None) -> DataFrame:
    """The records of all packages in ``packages.path``, each checked against its digest.

    A damaged directory, record or digest raises. A response has its payload, a revisit has none (null).
    """
    ranges = record_ranges(packages)
    ranges = ranges.repartition(partitions) if partitions else ranges

    def fetch(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        page = lambda urn: None if (x := urn.strip("<>").rpartition(":")[2]) == "None" else int(x)

        def rows():
            for batch in stream:
                for path, at, lengths in zip(*(batch.column(n).to_pylist() for n in ("path", "at", "lengths"))):
                    fs, name = store_of(path)
                    with fs.open_input_file(name) as f:
                        data, p = read_range(f, at, sum(lengths)), 0
                    for n in lengths:
                        h, body = parse_record(data[p : p + n])
                        p += n
                        digest, revisit = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"] == "revisit"
                        size = int(h["x-payload-bytes"])
                        if not revisit and (base32_sha1(body) != digest or len(body) != size):
                            raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
                        yield page(h["warc-record-id"]), h["warc-target-uri"], size, digest, h["warc-type"], page(h["warc-refers-to"]) if revisit else None, None if revisit or not payload else body

        yield from batches(rows(), schema, 500)

    return ranges.mapInArrow(fetch, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes every page to packages in the shared folder and returns what the packages say, without payloads."""
    spark = pages.sparkSession
    manifest = keep(write_packages(pages, scratch_path(spark, "warc")), "warc-manifest")
    return read_packages(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
