"""Web archives packaged in ZIP files: written whole, read by ranges.

A package is a ZIP file of stored members: ``archive/data.warc.gz`` with the records one after
another, each a gzip member of its own, and ``indexes/index.cdxj`` with a line for each record: the
URL as a sort key, the time, and JSON fields. The reader parses the end record, the (ZIP64) central
directory and the indexes, plain or gzipped, and then reads only the byte ranges of records; nothing is
extracted. It takes packages made elsewhere too: several archives, plain records, and records of
any type, with or without digests. Files are reached through Arrow's file systems (file, s3, hdfs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantavol.llm._common import Stage, need

# Fixed values of the ZIP format (APPNOTE): signatures, record layouts, the ZIP64 field and markers.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_FORMAT, CENTRAL_FORMAT, END_FORMAT = "<4s5H3I2H", "<4s6H3I5H2I", "<4s4H2IH"
END64_FORMAT, LOCATOR64_FORMAT = "<4sQ2H2I4Q", "<4sIQI"
FIELD64, FULL32, FULL16, UTF8_FLAG, LONGEST_COMMENT = 1, 0xFFFFFFFF, 0xFFFF, 0x800, 0xFFFF
# Fixed values of WARC 1.1.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PLAIN_ARCHIVE = "archive/data.warc"
ARCHIVES, INDEXES = "archive/", "indexes/"
#: Record ids of pages: with an id, and without.
PAGE, NO_PAGE = "urn:page:", "urn:page"
#: Bytes of records after which a package is closed.
PACKAGE_BYTES = 16 << 20
#: Neighbouring record ranges are read together up to so many bytes.
RANGE_BYTES = 4 << 20


class Member(NamedTuple):
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header_at: int


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and the path in it of a Hadoop-style URI."""
    for hadoop, arrow in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if uri.startswith(hadoop):
            uri = arrow + uri[len(hadoop) :]
    return pafs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; with zip64 also where sizes don't ask for it."""
    out, directory = io.BytesIO(), io.BytesIO()
    for name, data in members:
        at, crc, n = out.tell(), zlib.crc32(data), len(data)
        wide = zip64 or n >= FULL32 or at >= FULL32
        raw = name.encode()
        need_version = 45 if wide else 20
        short = FULL32 if wide else n
        local_extra = struct.pack("<2H2Q", FIELD64, 16, n, n) if wide else b""
        out.write(struct.pack(LOCAL_FORMAT, LOCAL, need_version, UTF8_FLAG, 0, 0, 33, crc, short, short, len(raw), len(local_extra)))
        out.write(raw + local_extra + data)
        extra = struct.pack("<2H3Q", FIELD64, 24, n, n, at) if wide else b""
        directory.write(struct.pack(CENTRAL_FORMAT, CENTRAL, need_version, need_version, UTF8_FLAG, 0, 0, 33, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, FULL32 if wide else at))
        directory.write(raw + extra)
    at, size, n = out.tell(), directory.tell(), len(members)
    out.write(directory.getvalue())
    wide = zip64 or at >= FULL32 or size >= FULL32 or n >= FULL16
    if wide:
        end_at = out.tell()
        out.write(struct.pack(END64_FORMAT, END64, struct.calcsize(END64_FORMAT) - 12, 45, 45, 0, 0, n, n, size, at))
        out.write(struct.pack(LOCATOR64_FORMAT, LOCATOR64, 0, end_at, 1))
    out.write(struct.pack(END_FORMAT, END, 0, 0, FULL16 if wide else n, FULL16 if wide else n, FULL32 if wide else size, FULL32 if wide else at, 0))
    return out.getvalue()


def read_directory(file: pa.NativeFile) -> list[Member]:
    """Members by the central directory, ZIP64 or not; reads the tail and the directory alone."""
    total = file.size()
    tail_at = max(0, total - struct.calcsize(END_FORMAT) - LONGEST_COMMENT - struct.calcsize(LOCATOR64_FORMAT))
    tail = file.read_at(total - tail_at, tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("not a ZIP file: no end record")
    _, _, _, _, count, size, at, _ = struct.unpack_from(END_FORMAT, tail, end)
    locator = end - struct.calcsize(LOCATOR64_FORMAT)
    if locator >= 0 and tail[locator : locator + 4] == LOCATOR64:
        _, _, end64_at, _ = struct.unpack_from(LOCATOR64_FORMAT, tail, locator)
        fields = struct.unpack(END64_FORMAT, file.read_at(struct.calcsize(END64_FORMAT), end64_at))
        if fields[0] != END64:
            raise ValueError("the ZIP64 locator points at no ZIP64 end record")
        count, size, at = fields[7], fields[8], fields[9]
    directory, out, p = file.read_at(size, at), [], 0
    for _ in range(count):
        sig, _, _, flags, method, _, _, crc, packed, full, n_name, n_extra, n_comment, _, _, _, header_at = struct.unpack_from(CENTRAL_FORMAT, directory, p)
        if sig != CENTRAL:
            raise ValueError("broken central directory")
        p += struct.calcsize(CENTRAL_FORMAT)
        name = directory[p : p + n_name].decode("utf-8" if flags & UTF8_FLAG else "cp437")
        extra = directory[p + n_name : p + n_name + n_extra]
        q = 0
        while q + 4 <= len(extra):
            kind, n = struct.unpack_from("<2H", extra, q)
            if kind == FIELD64:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                full = next(values) if full == FULL32 else full
                packed = next(values) if packed == FULL32 else packed
                header_at = next(values) if header_at == FULL32 else header_at
            q += 4 + n
        out.append(Member(name, method, crc, packed, full, header_at))
        p += n_name + n_extra + n_comment
    return out


def data_at(file: pa.NativeFile, m: Member) -> int:
    """Where a stored member's bytes start, by its local header."""
    if m.method != 0 or m.packed != m.size:
        raise ValueError(f"{m.name} isn't stored: its ranges can't be read")
    fields = struct.unpack(LOCAL_FORMAT, file.read_at(struct.calcsize(LOCAL_FORMAT), m.header_at))
    if fields[0] != LOCAL:
        raise ValueError(f"no local header of {m.name}")
    return m.header_at + struct.calcsize(LOCAL_FORMAT) + fields[9] + fields[10]


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if " " <= c != "\x7f" else f"%{ord(c):02X}" for c in value)


def page_urn(page_id: str | None) -> str:
    """The record id of a page; any string is one, and null has its own."""
    return NO_PAGE if page_id is None else PAGE + quote(page_id, safe="")


def sort_key(url: str) -> str:
    """A URL with its host's names in reverse order, as indexes are sorted by; others as they are."""
    try:
        parts = urlsplit(url)
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return quote(url, safe="/:?=&,()")
    if not parts.hostname:
        return quote(url, safe="/:?=&,()") or "-"
    host = ",".join(reversed(parts.hostname.split(".")))
    return quote(f"{host}{port}){(parts.path or '/').lower()}" + (f"?{parts.query.lower()}" if parts.query else ""), safe="/:?=&,()%")


def record_bytes(record_id: str | None, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or with refers_to a revisit record that leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{page_urn(record_id)}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        *([("WARC-Target-URI", _clean(uri))] if uri is not None else []),
        *([("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{page_urn(refers_to)}>")] if refers_to is not None else []),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    def page(self, name: str) -> str | None:
        """The page id in a header; ids that aren't of pages as they are."""
        value = self.headers.get(name)
        if value is None:
            return None
        value = value.strip().removeprefix("<").removesuffix(">")
        return None if value == NO_PAGE else unquote(value[len(PAGE) :]) if value.startswith(PAGE) else value


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines) if _}


def parse_record(data: bytes) -> tuple[Record, int]:
    """The record at the start of data, and its length."""
    if not data.startswith(b"WARC/"):
        raise ValueError("no WARC record here")
    head_end = data.index(b"\r\n\r\n")
    headers = _fields(data[:head_end].split(b"\r\n")[1:])
    at, n = head_end + 4, int(headers["content-length"])
    block = data[at : at + n]
    http_end = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
    http = _fields(block[:http_end].split(b"\r\n")[1:]) if http_end >= 0 else {}
    return Record(headers, http, block[http_end + 4 :] if http_end >= 0 else block), at + n + 4


def package(records: list[tuple[str | None, str | None, str, bytes]], zip64: bool = False) -> bytes:
    """A package of (record id, uri, digest, record bytes), the latter gzipped each by itself or all plain."""
    plain = bool(records) and records[0][3].startswith(b"WARC/")
    name, warc, lines = PLAIN_ARCHIVE if plain else ARCHIVE, io.BytesIO(), []
    for rid, uri, digest, data in records:
        fields = {"url": uri if uri is not None else page_urn(rid), "mime": "text/html", "status": "200", "digest": f"sha1:{digest}"}
        fields |= {"offset": str(warc.tell()), "length": str(len(data)), "filename": name.removeprefix(ARCHIVES)}
        lines.append(f"{sort_key(fields['url'])} 19700101000000 {json.dumps(fields)}")
        warc.write(data)
    return zip_bytes([(name, warc.getvalue()), (INDEX, "".join(x + "\n" for x in sorted(lines)).encode())], zip64)


def index_lines(data: bytes) -> Iterator[tuple[str | None, int, int]]:
    """(file name, offset, length) of each line of an index; lines of headers and comments are left out."""
    for line in data.splitlines():
        at = line.find(b"{")
        if at < 0 or line.startswith((b"!", b"#")):
            continue
        fields = json.loads(line[at:])
        if "offset" in fields and "length" in fields:
            yield fields.get("filename"), int(fields["offset"]), int(fields["length"])


def _unzipped(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def read_package(file: pa.NativeFile) -> Iterator[Record]:
    """All records of a package by its indexes, reading ranges of neighbours together.

    Indexes are members .cdxj, .cdx or these gzipped under indexes/; a line without a file name is
    of the only archive. What lies outside the ranges isn't read.
    """
    members = {m.name: m for m in read_directory(file)}
    indexes = [m for n, m in members.items() if n.startswith(INDEXES) and n.removesuffix(".gz").endswith((".cdxj", ".cdx"))]
    archives = {n.removeprefix(ARCHIVES): m for n, m in members.items() if n.startswith(ARCHIVES) and n.removesuffix(".gz").endswith(".warc")}
    if not indexes or not archives:
        raise ValueError("no index or no archive in the package")
    spans: dict[str, set[tuple[int, int]]] = {}
    for m in indexes:
        data = file.read_at(m.size, data_at(file, m))
        if zlib.crc32(data) != m.crc:
            raise ValueError("the index is damaged")
        for name, offset, length in index_lines(_unzipped(data)):
            if name is None and len(archives) > 1:
                raise ValueError("an index line names none of several archives")
            spans.setdefault(name.removeprefix(ARCHIVES) if name else next(iter(archives)), set()).add((offset, length))
    for name in sorted(spans):
        if name not in archives:
            raise ValueError(f"the index names {name}, which isn't in the package")
        yield from _read_ranges(file, archives[name], sorted(spans[name]))


def _read_ranges(file: pa.NativeFile, archive: Member, spans: list[tuple[int, int]]) -> Iterator[Record]:
    base, i = data_at(file, archive), 0
    while i < len(spans):
        j, start = i + 1, spans[i][0]
        while j < len(spans) and spans[j][0] + spans[j][1] - start <= RANGE_BYTES and spans[j][0] == spans[j - 1][0] + spans[j - 1][1]:
            j += 1
        data = file.read_at(spans[j - 1][0] + spans[j - 1][1] - start, base + start)
        for at, n in spans[i:j]:
            raw = _unzipped(data[at - start : at - start + n])
            record, used = parse_record(raw)
            if used != len(raw):
                raise ValueError("a record's length differs from the index")
            yield record
        i = j


def write_packages(rows: DataFrame, folder: str, zip64: bool = False) -> DataFrame:
    """Packages of rows (id, uri, payload, refers_to): one row (path, records, bytes) for each file.

    Every attempt writes a file of its own name, and only finished attempts are listed, so a lost
    executor leaves at most a file that nobody reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)

        def close(records: list[tuple[str | None, str | None, str, bytes]]) -> pa.RecordBatch:
            data, name = package(records, zip64), f"{uuid.uuid4().hex}.zip"
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(data)
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": len(records), "bytes": len(data)}])

        held, size = [], 0
        for batch in batches:
            for rid, uri, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("id", "uri", "payload", "refers_to"))):
                held.append((rid, uri, base32_sha1(payload), gzip.compress(record_bytes(rid, uri, payload, refers), 1, mtime=0)))
                size += len(held[-1][3])
                if size >= PACKAGE_BYTES:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    return rows.select("id", "uri", "payload", "refers_to").mapInArrow(run, "path string, records long, bytes long")


def read_packages(paths: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of packages (column path), with the payload if asked for.

    A payload that doesn't match its SHA-1 digest, or a broken package, raises. Without a digest in
    the record that of its payload is given; the size of a revisit's payload is null where no HTTP
    header tells it, and so is its digest where there is none. No paths give no rows.
    """
    schema = "id string, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string" + (", payload binary" if payloads else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payloads
        types = [pa.string()] * 4 + [pa.int64(), pa.string()] + [pa.binary()] * payloads
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, place = open_fs(path)
                held: list[tuple] = []
                with fs.open_input_file(place) as file:
                    for r in read_package(file):
                        kind, digest = r.headers.get("warc-type"), r.headers.get("warc-payload-digest")
                        if kind == "revisit":
                            size = int(r.http["content-length"]) if "content-length" in r.http else None
                        else:
                            size, own = len(r.payload), f"sha1:{base32_sha1(r.payload)}"
                            if kind == "response" and digest is not None and digest.lower().startswith("sha1:") and digest[5:].upper() != own[5:]:
                                raise ValueError(f"payload of {r.headers.get('warc-record-id')} doesn't match its digest")
                            digest = digest if digest is not None else own
                        digest = digest[5:] if digest is not None and digest.lower().startswith("sha1:") else digest
                        held.append((r.page("warc-record-id"), r.headers.get("warc-target-uri"), kind, r.page("warc-refers-to"), size, digest, *([r.payload] if payloads else [])))
                        if len(held) >= (64 if payloads else 8192):
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*held), types)], names=names)
                            held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*held), types)], names=names)

    return paths.select("path").mapInArrow(run, schema)


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows (id, uri, payload, refers_to) of pages: null html is an empty payload.

    Of pages with equal payloads of min_bytes or more, the smallest page_id is stored; the others
    refer to it. Rows that repeat the smallest page_id are stored as well; null page_ids refer to
    the smallest that isn't null, and are stored if there is none.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = need(pages, "page_id", "url", "html").select("page_id", F.col("url").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("_digest", F.unhex(F.sha1("payload")))
    # Only ids and digests are grouped by payload; payloads move once, by their own id.
    narrow = rows.filter(F.octet_length("payload") >= min_bytes).select("page_id", "_digest")
    first = narrow.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("_digest").alias("_d"), "_first")
    again = narrow.distinct().join(first, F.col("_digest") == F.col("_d")).filter(~F.col("page_id").eqNullSafe(F.col("_first")))
    again = again.select(F.col("page_id").alias("_p"), "_d", F.col("_first").cast("string").alias("refers_to"))
    joined = rows.join(again, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("_digest") == F.col("_d")), "left")
    return joined.select(F.col("page_id").cast("string").alias("id"), "uri", "payload", "refers_to")


def archive_pages(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages to packages in the shared folder, reads the packages back, and gives a row a page."""
    stage = Stage(spark, "warc")
    written = stage.table(write_packages(mark_revisits(pages, min_bytes), f"{stage.path}/packages"), "manifest", "snappy")
    # One task a package, at most as many as there are packages; paths are a few bytes.
    spread = written.repartition(max(1, min(written.count(), 10_000)), "path")
    kind = pages.schema["page_id"].dataType
    back = read_packages(spread)
    return back.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
