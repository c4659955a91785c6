"""WARC records in ZIP packages: written by tasks, and read back by range without extracting a member.

An archive holds stored members: `archive/data.warc.gz` (one gzip member per record) and `indexes/index.cdx` (one line
per record: place, length and id). Readers find both members through the central directory, in its ZIP64 form too,
and read runs of neighbouring records by their place in the file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from functools import partial
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from turnstile.llm.common import in_batches, scratch, slices, strings, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: A task starts another archive when one has so many bytes of records.
ARCHIVE_BYTES = 64 << 20
#: Records that one reading task takes from an archive, and bytes that it reads at once.
RANGE_RECORDS, RANGE_BYTES = 2000, 4 << 20

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO = 0xFFFFFFFF


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI as tasks reach it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without the payload if it refers to another page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]", errors="surrogatepass"))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Parsed(NamedTuple):
    page_id: int | None
    url: str | None
    payload: bytes | None
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def parse(raw: bytes) -> Parsed:
    """A record; a response's digest is taken from its payload and must be the one it states."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_fields(http)["content-length"])
    stated, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    number = lambda name: int(n) if name in fields and (n := fields[name][10:-1]) else None
    if kind == "response" and (len(payload) != size or digest(payload) != stated):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    return Parsed(number("warc-record-id"), fields.get("warc-target-uri"), payload if kind == "response" else None, size, stated, kind, number("warc-refers-to"))


# --- archives


class Member(NamedTuple):
    name: str
    header: int
    size: int
    stored: bool


def _wide(extra: bytes, small: tuple[int, int, int]) -> tuple[int, int, int]:
    """Size, stored size and place, from the ZIP64 field where the short ones are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            numbers = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            return tuple(next(numbers) if n == _NO else n for n in small)
        at += 4 + length
    return small


def members(file: BinaryIO, size: int) -> dict[str, Member]:
    """The central directory of a ZIP or ZIP64 file."""
    tail_at = max(0, size - 22 - 65535 - 20)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no ZIP directory")
    count, length, place = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (wide_at,) = struct.unpack_from("<Q", tail, end - 12)
        file.seek(wide_at)
        wide = file.read(56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 directory where it should be")
        count, length, place = struct.unpack_from("<QQQ", wide, 32)
    file.seek(place)
    directory = file.read(length)
    out, at = {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged ZIP directory")
        (method,) = struct.unpack_from("<H", directory, at + 10)
        packed, full = struct.unpack_from("<II", directory, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", directory, at + 28)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode()
        full, packed, header = _wide(directory[at + 46 + n_name : at + 46 + n_name + n_extra], (full, packed, header))
        out[name] = Member(name, header, packed, method == 0)
        at += 46 + n_name + n_extra + n_comment
    return out


def data_start(file: BinaryIO, member: Member) -> int:
    """Where a stored member's bytes begin: after its local header, whose extra field may differ from the directory's."""
    if not member.stored:
        raise ValueError(f"{member.name} is compressed, its parts can't be read by range")
    file.seek(member.header)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


class _Archive:
    """One archive in the making; it appears under its name only when it is whole."""

    def __init__(self, folder: str):
        self.store, path = _store(folder)
        self.store.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.wacz"
        self.uri, self.path = f"{folder}/{self.name}", f"{path}/{self.name}"
        self.out = self.store.open_output_stream(self.path + ".part")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.bytes, self.lines = 0, []

    def add(self, page_id: int | None, raw: bytes) -> None:
        packed = gzip.compress(raw, compresslevel=1, mtime=0)
        self.data.write(packed)
        self.lines.append(f"{self.bytes} {len(packed)} {'-' if page_id is None else page_id}\n")
        self.bytes += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(INDEX, "".join(self.lines))
        self.zip.close()
        self.out.close()
        self.store.move(self.path + ".part", self.path)
        return self.uri, len(self.lines), self.bytes


def _write(folder: str, archive_bytes: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, html, refers_to) to archives; one row per archive comes out."""
    archive, done = None, []
    for batch in slices(batches):
        payloads = strings(batch.column(2)).to_pylist()
        for page_id, url, payload, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), payloads, batch.column(3).to_pylist(), strict=True):
            archive = archive or _Archive(folder)
            archive.add(page_id, record(page_id, url, payload.encode("utf-8", "surrogatepass"), refers_to))
            if archive.bytes >= archive_bytes:
                done.append(archive.close())
                archive = None
    if archive:
        done.append(archive.close())
    columns = list(zip(*done, strict=True)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["archive", "records", "bytes"])


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives of all pages in the shared scratch folder: archive, records, bytes.

    Of pages with equal payloads of at least `min_bytes` the smallest id is a response; others are revisits of it.
    Equal payloads are found by their SHA-1 in one sum per digest, so a payload that very many pages share is one
    partial row per task; only digests that occur twice are joined back. A null html is an empty payload. A page
    without an id can be a revisit, not a page that others refer to.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    shared = rows.filter(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("sha", "first")
    joined = rows.join(written(shared, "shared"), "sha", "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    folder = scratch(pages.sparkSession, "warc")
    made = joined.select("page_id", "url", "html", refers.alias("refers_to"))
    return written(in_batches(made, partial(_write, folder, archive_bytes), "archive string, records long, bytes long"), "archives")


#: Ranges are read by at most so many tasks.
MOST_TASKS = 20_000


def read_range(uri: str, first: int, last: int) -> Iterator[Parsed]:
    """Records `first` to `last` (exclusive) of an archive, in the order of its index."""
    store, path = _store(uri)
    with store.open_input_file(path) as file:
        found = members(file, file.size())
        index, data = found[INDEX], found[DATA]
        file.seek(data_start(file, index))
        lines = io.BytesIO(file.read(index.size)).readlines()[first:last]
        places = [tuple(map(int, line.split()[:2])) for line in lines]
        base, at = data_start(file, data), 0
        while at < len(places):
            to = at + 1
            while to < len(places) and places[to][0] + places[to][1] - places[at][0] <= RANGE_BYTES:
                to += 1
            file.seek(base + places[at][0])
            run = file.read(places[to - 1][0] + places[to - 1][1] - places[at][0])
            for place, length in places[at:to]:
                start = place - places[at][0]
                yield parse(zlib.decompress(run[start : start + length], wbits=31))
            at = to


_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(with_payload: bool, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for uri, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part: list[Parsed] = []
            for parsed in read_range(uri, first, last):
                part.append(parsed if with_payload else parsed._replace(payload=None))
                if len(part) == 256:
                    yield pa.RecordBatch.from_pylist([p._asdict() for p in part], schema=schema)
                    part = []
            yield pa.RecordBatch.from_pylist([p._asdict() for p in part], schema=schema)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives (archive, records), read by ranges: page_id, url, payload, payload_bytes,
    payload_digest, record_type, refers_to. A revisit has no payload; its bytes and digest are those of the page that
    it stands for. No archive gives no rows."""
    ranges = archives.select("archive", F.col("records"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(RANGE_RECORDS).cast("long"))).alias("first"))
    ranges = ranges.select("archive", "first", F.least("records", F.col("first") + RANGE_RECORDS).alias("last"))
    # Rows of a few bytes stand for megabytes each, so their number says how far they are spread, not their size.
    parts = max(1, min(MOST_TASKS, ranges.count()))
    return in_batches(ranges.repartition(parts, "archive", "first"), partial(_read, with_payload), _SCHEMA)
