"""Web archives packaged in ZIP files: written, and read by ranges without extraction.

Each task writes one package: a stored member of WARC records, each compressed
by itself, and a stored index of where they lie. The reader parses the end
records, ZIP64 included, and the central directory, finds where the stored
members' bytes begin, and reads each record through the index by offset and
length, adjoining ones together. Only the shared folder holds packages.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octetloom.llm.common import broadcast_if_small, ensure_checkpoint_dir, materialised

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes that one range read asks for, at most, unless a record is longer.
READ_BYTES = 4 << 20
READ = Callable[[int, int], bytes]


class BadArchive(ValueError):
    """The bytes are not a ZIP package that can be read by ranges."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


def directory(read: READ, size: int) -> list[Member]:
    """The members by the central directory of a package of ``size`` bytes."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise BadArchive("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    end = tail_at + at
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = read(end - 20, 20) if end >= 20 else b""
        if locator[:4] != b"PK\x06\x07":
            raise BadArchive("no ZIP64 locator")
        end = struct.unpack_from("<Q", locator, 8)[0]
        record = read(end, 56)
        if record[:4] != b"PK\x06\x06":
            raise BadArchive("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    shift = end - length - start  # bytes before the package
    if shift < 0:
        raise BadArchive("central directory out of bounds")
    raw, out, p = read(start + shift, length), [], 0
    for _ in range(count):
        if raw[p : p + 4] != b"PK\x01\x02" or len(raw) < p + 46:
            raise BadArchive("broken central directory")
        method, packed, full = struct.unpack_from("<H", raw, p + 10)[0], *struct.unpack_from("<II", raw, p + 20)
        n, x, c = struct.unpack_from("<HHH", raw, p + 28)
        header = struct.unpack_from("<I", raw, p + 42)[0]
        name, extra = raw[p + 46 : p + 46 + n], raw[p + 46 + n : p + 46 + n + x]
        q = 0
        while q + 4 <= len(extra):
            kind, size_ = struct.unpack_from("<HH", extra, q)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{size_ // 8}Q", extra, q + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            q += 4 + size_
        out.append(Member(name.decode(), method, packed, header + shift))
        p += 46 + n + x + c
    return out


def stored_span(read: READ, member: Member) -> tuple[int, int]:
    """Where the bytes of a stored member lie: offset and length."""
    if member.method:
        raise BadArchive(f"{member.name} is compressed by the package")
    head = read(member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise BadArchive(f"{member.name} has no local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26)), member.size


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _line(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A response, or (with ``first``) a revisit that keeps the response's headers and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    head += [] if first is None else [f"WARC-Refers-To: {_urn(first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    page_id: int | None
    url: str | None
    record_type: str
    refers_to: int | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse(raw: bytes) -> Record:
    """One record. The digest and length of a response are those of its payload; a damaged payload is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise BadArchive("no WARC record")
    named = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    said = named["WARC-Payload-Digest"].removeprefix("sha1:")
    response = named["WARC-Type"] == "response"
    if response and (len(payload) != length or payload_digest(payload) != said):
        raise BadArchive("payload does not match its digest")
    url = named.get("WARC-Target-URI")
    url = None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return Record(_page(named["WARC-Record-ID"]), url, named["WARC-Type"], _page(named.get("WARC-Refers-To")), length, said, payload if response else None)


def _gzip(raw: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with first: of equal payloads of at least ``least_bytes``, the smallest page_id, on the others.

    Payloads meet as digests and lengths; minima are aggregated before the
    shuffle, and pages join them by page_id, so no payload is gathered anywhere.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    raw = F.col("html").cast("binary")
    marks = materialised(pages.where("page_id IS NOT NULL").select("page_id", F.sha1(raw).alias("digest"), F.octet_length(raw).alias("n")).where(F.col("n") >= least_bytes))
    firsts = materialised(marks.groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").drop("last"))
    later = materialised(marks.join(firsts, ["digest", "n"]).where("page_id > first").groupBy("page_id", "digest").agg(F.min("first").alias("first")))
    later = later.select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "first")
    joined = pages.join(broadcast_if_small(later, later.count()), (F.col("page_id") == F.col("__id")) & (F.sha1(raw) == F.col("__digest")), "left")
    return joined.select("page_id", "url", "html", "first")


def write_package(batches: Iterator[pa.RecordBatch], folder: str, number: int) -> tuple[str, int] | None:
    """Writes the rows (page_id, url, html, first) as one package under a name that no other attempt uses; its path and number of records, or None without rows."""
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    name = f"part-{number:06d}-{uuid.uuid4().hex}.wacz"
    at, index, n = 0, [], 0
    with store.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
            for b in batches:
                for page_id, url, html, first in zip(*(c.to_pylist() for c in b.columns)):
                    raw = _gzip(record(page_id, url, html.encode(), first))
                    data.write(raw)
                    index.append(json.dumps({"page_id": page_id, "offset": at, "length": len(raw)}))
                    at, n = at + len(raw), n + 1
        z.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
    if n:
        return f"{folder.rstrip('/')}/{name}", n
    store.delete_file(f"{base}/{name}")
    return None


def write_packages(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes one package per partition into ``folder`` (a URI all executors share) and returns their paths and numbers of records.

    Every attempt of a task writes a package of its own and nothing is renamed or
    replaced, on any store: the rows returned are those of the attempt that
    counted, and what a failed or doubled attempt leaves is in no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = write_package(batches, folder, TaskContext.get().partitionId())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([done[0]]), pa.array([done[1]], pa.int64())], ["path", "records"])

    return materialised(with_revisits(pages, least_bytes).mapInArrow(run, "path string, records long"))


def records(path: str) -> Iterator[Record]:
    """The records of one package, read by ranges."""
    store, name = pafs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        size = f.size()

        def read(at: int, n: int) -> bytes:
            if at < 0 or at + n > size:
                raise BadArchive("range out of bounds")
            return f.read_at(n, at)

        members = {m.name: m for m in directory(read, size)}
        if DATA not in members or INDEX not in members:
            raise BadArchive("no archive or no index")
        start, length = stored_span(read, members[DATA])
        entries = [json.loads(x) for x in read(*stored_span(read, members[INDEX])).decode().splitlines()]
        i = 0
        while i < len(entries):
            j, first = i + 1, entries[i]["offset"]
            end = first + entries[i]["length"]
            while j < len(entries) and entries[j]["offset"] == end and end + entries[j]["length"] - first <= READ_BYTES:
                end += entries[j]["length"]
                j += 1
            if end > length:
                raise BadArchive("record out of bounds")
            chunk = read(start + first, end - first)
            for e in entries[i:j]:
                yield parse(zlib.decompress(chunk[e["offset"] - first : e["offset"] - first + e["length"]], 31))
            i = j


def read_packages(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the packages at ``path``."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                held, size = [], 0
                for r in records(path):
                    held.append(r)
                    size += r.payload_bytes
                    if len(held) >= 1000 or with_payload and size >= READ_BYTES:
                        yield _batch(held, names, kinds)
                        held, size = [], 0
                yield _batch(held, names, kinds)

    kind = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    return packages.select("path").mapInArrow(run, kind)


def _batch(held: list[Record], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([getattr(r, n) for r in held], k) for n, k in zip(names, kinds)], names)


def shared_folder(spark) -> str:
    """A new folder within the one that all executors share, as a URI."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base if ':/' in base else f'file://{base}'}".rstrip("/").replace("file:///", "file:/").replace("file:/", "file:///", 1) + f"/packages-{uuid.uuid4().hex}"


def op4_warc_packages(spark, sf_dir: str) -> DataFrame:
    """Every page written to packages and read back.

    A null page is an empty payload; rows that repeat a page_id with the payload's
    smallest id are all responses; a null page_id is a response that nothing
    refers to; an empty table gives no packages and no rows.
    """
    packages = write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_folder(spark))
    return read_packages(packages, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hexed FROM pages),
f AS (SELECT hexed, min(page_id) AS first FROM p GROUP BY hexed)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hexed, 1 + 5 * i // 4, 2))::INTEGER >> (3 - 5 * i % 4)::INTEGER) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM p JOIN f USING (hexed)
"""
