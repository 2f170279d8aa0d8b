"""Web records in ZIP archives: written as stored WARC members with an index, read by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import arrow_batches, written
from rowloom.session import fresh_path

ARCHIVE_BYTES = 64 << 20  # a task starts another archive beyond this
READ_BYTES = 1 << 20  # neighbouring records are read together up to this
RECORDS, INDEX = re.compile(r"archive/.*\.warc\.gz"), re.compile(r"indexes/.*\.cdxj")
# Fixed values of the ZIP format: signatures of its records and the size that says "see ZIP64".
LOCAL, CENTRAL, END, END64, LOCATOR64, DESCRIPTOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0x08074B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class ZipWriter:
    """Stored members of unknown size on an append-only stream, always with ZIP64 sizes."""

    def __init__(self, stream) -> None:
        self.stream, self.at, self.members = stream, 0, []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def open(self, name: str) -> None:
        self.members.append([name.encode(), self.at, 0, 0])
        # Bit 3: size and checksum follow the data; bit 11: the name is UTF-8.
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x808, 0, 0, 0x21, 0, FULL32, FULL32, len(name.encode()), 20))
        self._put(name.encode() + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, data: bytes) -> None:
        member = self.members[-1]
        member[2], member[3] = zlib.crc32(data, member[2]), member[3] + len(data)
        self._put(data)

    def end(self) -> None:
        _, _, check, size = self.members[-1]
        self._put(struct.pack("<IIQQ", DESCRIPTOR, check, size, size))

    def close(self) -> None:
        begin = self.at
        for name, place, check, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, place)
            head = (CENTRAL, 45, 45, 0x808, 0, 0, 0x21, check, FULL32, FULL32, len(name), len(extra), 0, 0, 0, 0, FULL32)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", *head) + name + extra)
        size, count, end64 = self.at - begin, len(self.members), self.at
        self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, size, begin))
        self._put(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
        self.stream.close()


def members(source) -> dict[str, tuple[int, int]]:
    """First byte and size of each stored member, from the central directory of a random-access file."""
    size = source.size()
    tail = source.read_at(min(size, 22 + FULL16), max(0, size - 22 - FULL16))
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise ValueError("not a ZIP archive")
    count, length, begin = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == count or FULL32 in (length, begin):
        locator = source.read_at(20, size - len(tail) + at - 20)
        signature, _, end64, _ = struct.unpack("<IIQI", locator)
        if signature != LOCATOR64:
            raise ValueError("the ZIP64 locator is missing")
        count, length, begin = struct.unpack_from("<QQQ", source.read_at(56, end64), 32)
    directory, found, at = source.read_at(length, begin), {}, 0
    for _ in range(count):
        head = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if head[0] != CENTRAL:
            raise ValueError("the central directory is broken")
        method, packed, plain, name_size, extra_size, note_size, place = head[4], head[8], head[9], head[10], head[11], head[12], head[16]
        name = directory[at + 46 : at + 46 + name_size].decode()
        extra, k = directory[at + 46 + name_size : at + 46 + name_size + extra_size], 0
        while k + 4 <= len(extra):
            kind, more = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                # Only the fields that are full in the directory are here, in this order.
                wide = list(struct.unpack_from(f"<{more // 8}Q", extra, k + 4))
                plain = wide.pop(0) if plain == FULL32 else plain
                packed = wide.pop(0) if packed == FULL32 else packed
                place = wide.pop(0) if place == FULL32 else place
            k += 4 + more
        if method != 0 or packed != plain:
            raise ValueError(f"{name} is compressed and cannot be read in ranges")
        own_name, own_extra = struct.unpack("<HH", source.read_at(4, place + 26))
        found[name] = (place + 30 + own_name + own_extra, plain)
        at += 46 + name_size + extra_size + note_size
    return found


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers: int | None) -> bytes:
    """One WARC record; without a payload it revisits the record of page ``refers``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if payload is None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """What ``record`` wrote: ids, type, digest, size and payload; the payload's digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (base32_sha1(payload) != digest or len(payload) != size):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is broken")
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").rstrip(">")) else None
    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "payload_digest": digest,
        "payload_bytes": size,
        "refers_to": number("WARC-Refers-To"),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``page_id, url, html`` into ZIP archives below ``folder``; return ``path, records``.

    The payload is the html as UTF-8, nothing if it is null. Of equal payloads of at least ``least_bytes`` bytes the
    smallest page id is the response and others revisit it; rows that repeat it are responses too. A
    null id revisits like others but is never referred to: where there are no ids, all are responses.

    Equal payloads are counted by SHA-1 before any html moves, and only digests that occur
    again are joined, so unique pages are never shuffled when those are few. An archive has a stored member of
    records, each compressed by itself, and one of index lines. Archives get new names in every attempt and only those
    of finished tasks are listed, so a task may be lost and run again.
    """
    spark = pages.sparkSession
    arrow_batches(spark, 64)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    again = rows.filter(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = written(again.filter("n > 1 AND first IS NOT NULL").select("digest", "first"), "repeated-payloads")
    marked = rows.join(again, "digest", "left").withColumn("refers", F.expr("CASE WHEN first IS NOT NULL AND NOT (first <=> page_id) THEN first END"))
    marked = marked.select("page_id", "url", "html", "refers")
    return written(marked.mapInArrow(_write(folder, archive_bytes), "path string, records bigint"), "archives")


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, index, done = None, [], []

        def finish() -> None:
            archive.end()
            archive.open("indexes/index.cdxj")
            for line in index:
                archive.write(line)
            archive.end()
            archive.close()
            done.append((path, len(index)))

        for batch in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None:
                    store, base = fs.FileSystem.from_uri(folder)
                    store.create_dir(base, recursive=True)
                    name = f"pages-{uuid.uuid4().hex}.wacz"
                    path, archive, index = f"{folder}/{name}", ZipWriter(store.open_output_stream(f"{base}/{name}")), []
                    archive.open("archive/data.warc.gz")
                data = html.encode()
                digest = base32_sha1(data)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = packer.compress(record(page_id, url, data if refers is None else None, len(data), digest, refers)) + packer.flush()
                entry = {"offset": archive.members[-1][3], "length": len(packed), "digest": f"sha1:{digest}", "url": url}
                index.append(f"{'' if page_id is None else page_id} {json.dumps(entry)}\n".encode())
                archive.write(packed)
                if archive.at > archive_bytes:
                    finish()
                    archive = None
        if archive is not None:
            finish()
        columns = list(zip(*done)) if done else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], names=["path", "records"])

    return run


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """All records of the archives at ``path``: ids, url, type, digest, size, ``refers_to`` and ``payload``.

    A task opens an archive where it lies, finds the members in its central directory, reads the
    index and then ranges of records; nothing is unpacked to disk and no more than about 1 MB or one record is held.
    Archives are read through the file system that their path names.
    """
    count = archives.count()
    spread = archives.select("path").repartition(max(1, min(count, 10_000)))
    schema = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"
    return spread.mapInArrow(_read, schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, inner = fs.FileSystem.from_uri(path)
            with store.open_input_file(inner) as source:
                found = members(source)
                start = next(place for name, (place, _) in found.items() if RECORDS.fullmatch(name))
                index_at, index_size = next(x for name, x in found.items() if INDEX.fullmatch(name))
                for data in _ranges(source, start, _index(source, index_at, index_size)):
                    rows = [parse_record(zlib.decompress(x, 31)) for x in data]
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in fields], names=[n for n, _ in fields])


def _index(source, at: int, size: int) -> Iterator[tuple[int, int]]:
    """Offsets and lengths of the index lines, read piece by piece."""
    rest = b""
    for begin in range(0, size, READ_BYTES):
        lines = (rest + source.read_at(min(READ_BYTES, size - begin), at + begin)).split(b"\n")
        rest = lines.pop()
        for line in lines:
            entry = json.loads(line.split(b" ", 1)[1])
            yield entry["offset"], entry["length"]


def _ranges(source, start: int, entries: Iterator[tuple[int, int]]) -> Iterator[list[bytes]]:
    """The records, neighbours by one read."""
    waiting: list[tuple[int, int]] = []
    for offset, length in chain(entries, [(-1, 0)]):
        if waiting and (offset != sum(waiting[-1]) or offset + length - waiting[0][0] > READ_BYTES):
            begin = waiting[0][0]
            data = source.read_at(sum(waiting[-1]) - begin, start + begin)
            yield [data[o - begin : o - begin + n] for o, n in waiting]
            waiting = []
        waiting.append((offset, length))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages into new archives in the shared folder and read these again."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, fresh_path(spark, "archives"), least_bytes))
