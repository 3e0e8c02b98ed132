"""The container of coded volumes: header, codebooks and chunk payloads in one file.

`spark.read.format("qvol")` gives (chunk, n_bytes, payload, book): the header is read on the driver,
payloads by ranges in the tasks. `df.write.format("qvol")` writes a container from chunks.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quantavol.operators import codec, tiling
from quantavol.options import Dims, Mode, OptionError, Quantization, QuantOptions
from quantavol.sources import files

# Fixed values of the format: mark, and a big-endian header of kind, bits, book-a-chunk, volume and tile dimensions.
MAGIC = b"QCMPFILE"
FIXED = ">8sBB?6H"
# Volumes of more than 65,535 planes don't fit that header: their mark differs, and the number of planes has 32 bits.
DEEP_MAGIC = b"QCMPDEEP"
DEEP_FIXED = ">8sBB?HHI3H"
CHUNK_ROWS = "chunk int, n_bytes long, payload binary, book binary"


@dataclass
class Header:
    """What stands before the body; sizes has a payload size for each chunk."""

    kind: Quantization
    bits: int
    book_each: bool
    dims: Dims
    tile: Dims | None
    sizes: list[int] = field(default_factory=list)

    @property
    def k(self) -> int:
        return 1 << self.bits

    @property
    def chunks(self) -> int:
        return tiling.layer_count(self.dims.z, self.tile.z) if self.kind is Quantization.VECTOR_3D else self.dims.z

    @property
    def deep(self) -> bool:
        return self.dims.z > 65535

    @property
    def size(self) -> int:
        return struct.calcsize(DEEP_FIXED if self.deep else FIXED) + 4 * self.chunks

    @property
    def body_size(self) -> int:
        books = self.chunks if self.book_each else 1
        return sum(self.sizes) + books * codec.book_size(self.k, self.tile)

    def problems(self) -> list[str]:
        out = []
        if self.kind is Quantization.INVALID:
            out.append("unknown quantization")
        if not 1 <= self.bits <= 8:
            out.append(f"{self.bits} bits")
        if min(self.dims) < 1:
            out.append(f"volume of {self.dims}")
        if self.kind.is_one_of(Quantization.VECTOR_1D, Quantization.VECTOR_2D, Quantization.VECTOR_3D) and self.tile is None:
            out.append("no tile")
        return out

    def pack_fixed(self) -> bytes:
        """The header without the sizes of payloads."""
        if max(self.dims.x, self.dims.y, *(self.tile or (0,))) > 65535 or self.dims.z >= 1 << 32:
            raise OptionError("the container holds planes and tiles up to 65535 wide and high, and 2^32 - 1 planes")
        mark, fixed = (DEEP_MAGIC, DEEP_FIXED) if self.deep else (MAGIC, FIXED)
        return struct.pack(fixed, mark, int(self.kind), self.bits, self.book_each, *self.dims, *(self.tile or (0, 0, 0)))

    def pack(self) -> bytes:
        if max(self.sizes, default=0) >= 1 << 32:
            raise OptionError("the container holds chunks below 4 GB")
        sizes = self.sizes or [0] * self.chunks
        return self.pack_fixed() + struct.pack(f">{len(sizes)}I", *sizes)

    @classmethod
    def unpack(cls, data: bytes) -> Header:
        layout = DEEP_FIXED if data[:8] == DEEP_MAGIC else FIXED
        if len(data) < struct.calcsize(layout) or data[:8] not in (MAGIC, DEEP_MAGIC):
            raise OptionError("no container: the mark is missing")
        _, kind, bits, each, *six = struct.unpack_from(layout, data)
        tile = Dims(*six[3:]) if all(six[3:]) else None
        head = cls(Quantization.of_code(kind), bits, each, Dims(*six[:3]), tile)
        if head.kind is Quantization.VECTOR_3D and tile is None:
            raise OptionError("no container: 3-D tiles without dimensions")
        if head.deep != (layout == DEEP_FIXED):
            raise OptionError(f"no container: the mark doesn't go with {head.dims.z} planes")
        if len(data) >= head.size:
            head.sizes = list(struct.unpack_from(f">{head.chunks}I", data, struct.calcsize(layout)))
        return head

    @classmethod
    def of_options(cls, o: QuantOptions) -> Header:
        return cls(o.kind, o.bits, o.mode is Mode.INDIVIDUAL, Dims(o.dims.x, o.dims.y, o.plane_count), o.tile)


def read_header(path: str) -> Header:
    head = Header.unpack(files.read_range(path, 0, struct.calcsize(DEEP_FIXED)))
    return Header.unpack(files.read_range(path, 0, head.size))


def check_file(path: str, head: Header) -> None:
    """Raises if the header is invalid or the file's size isn't what the header says."""
    if found := head.problems():
        raise OptionError(f"{path}: {', '.join(found)}")
    n = files.size_of(path)
    if n != head.size + head.body_size:
        raise OptionError(f"{path} has {n} bytes; its header tells of {head.size + head.body_size}")


@dataclass
class Spans(InputPartition):
    """Neighbouring chunks: the first one's number, where it begins in the file, and sizes of payloads."""

    first: int
    at: int
    sizes: np.ndarray


def spans(head: Header) -> list[Spans]:
    """The chunks of a file in partitions. A chunk is its codebook, if each has one, and its payload."""
    book = codec.book_size(head.k, head.tile)
    sizes, own = np.array(head.sizes, dtype=np.int64), book if head.book_each else 0
    ends = head.size + (0 if head.book_each else book) + np.cumsum(sizes + own)
    # Payloads unpack to several times their size.
    each = files.items_each(head.chunks, 4 * 2 * -(-head.dims.count // max(head.chunks, 1)))
    return [Spans(i, int(ends[i] - sizes[i] - own), sizes[i : i + each]) for i in range(0, len(sizes), each)] or [Spans(0, head.size, sizes)]


class ContainerReader(DataSourceReader):
    def __init__(self, path: str, head: Header):
        self.path, self.head = path, head

    def partitions(self) -> list[Spans]:
        return spans(self.head)

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        fs, path = files.locate(self.path)
        book_size, sizes = codec.book_size(self.head.k, self.head.tile), partition.sizes
        own = book_size if self.head.book_each else 0
        if not len(sizes):
            return
        with fs.open_input_file(path) as f:
            shared = None if own else f.read_at(book_size, self.head.size)
            # A row has its codebook, also where all share one.
            ends, group = partition.at + np.cumsum(sizes + own), np.cumsum(sizes + book_size) // files.AT_ONCE
            for i, j in pairwise([0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]):
                begin = int(ends[i] - sizes[i] - own)
                data = f.read_at(int(ends[j - 1]) - begin, begin)
                to = (ends[i:j] - begin).tolist()
                payloads = [data[b - n : b] for b, n in zip(to, sizes[i:j].tolist())]
                books = [data[b - n - own : b - n] for b, n in zip(to, sizes[i:j].tolist())] if own else [shared] * (j - i)
                yield pa.RecordBatch.from_pydict(
                    {"chunk": pa.array(np.arange(partition.first + i, partition.first + j, dtype=np.int32)), "n_bytes": pa.array(sizes[i:j]), "payload": pa.array(payloads, type=pa.binary()), "book": pa.array(books, type=pa.binary())}
                )


@dataclass
class Parts(WriterCommitMessage):
    parts: list[files.Staged]


class ContainerWriter(DataSourceArrowWriter):
    """Each task writes its chunks to a file of its own; the commit knows all sizes, so the header is written once."""

    def __init__(self, path: str, head: Header, shared_book: bytes):
        self.path, self.head, self.shared_book = path, head, shared_book
        self.staging = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        book_size = codec.book_size(self.head.k, self.head.tile)

        def chunks() -> Iterator[tuple[int, bytes]]:
            for b in iterator:
                books = b.column("book").to_pylist() if self.head.book_each else [b""] * b.num_rows
                for number, payload, book in zip(b.column("chunk").to_pylist(), b.column("payload").to_pylist(), books):
                    if self.head.book_each and len(book or b"") != book_size:
                        raise OptionError(f"chunk {number} has no codebook of {book_size} bytes")
                    yield number, book + payload

        return Parts(files.stage(self.staging, chunks()))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        joined = files.Joined([p for m in messages if m for p in m.parts])
        if not np.array_equal(joined.numbers, np.arange(self.head.chunks)):
            raise OptionError(f"chunks 0..{self.head.chunks - 1} are wanted, each once")
        own = codec.book_size(self.head.k, self.head.tile) if self.head.book_each else 0
        self.head.sizes = (joined.sizes - own).tolist()

        def body() -> Iterator[bytes]:
            yield self.head.pack()
            yield self.shared_book
            yield from joined.data()

        files.write_all(self.path, body())
        files.remove(self.staging)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files.remove(self.staging)


class VolumeContainer(DataSource):
    """Options: path; to write also header (hex of the packed header, sizes may be missing) and book (hex of a shared codebook)."""

    @classmethod
    def name(cls) -> str:
        return "qvol"

    def schema(self) -> str:
        return CHUNK_ROWS

    def reader(self, schema: StructType) -> ContainerReader:
        path = self.options["path"]
        head = read_header(path)
        check_file(path, head)
        return ContainerReader(path, head)

    def writer(self, schema: StructType, overwrite: bool) -> ContainerWriter:
        return ContainerWriter(self.options["path"], Header.unpack(bytes.fromhex(self.options["header"])), bytes.fromhex(self.options.get("book", "")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VolumeContainer)


def write_container(chunks: DataFrame, path: str, head: Header, book: codec.Codebook | None = None) -> None:
    """Writes chunks (with their books if the header asks for them) to one file."""
    if not head.book_each and book is None:
        raise OptionError("a shared codebook is missing")
    register(chunks.sparkSession)
    shared = b"" if head.book_each else codec.book_bytes(book)
    columns = ["chunk", "n_bytes", "payload"] + (["book"] if head.book_each else [])
    chunks.select(*columns).write.format("qvol").option("header", head.pack_fixed().hex()).option("book", shared.hex()).mode("append").save(path)


def read_container(spark: SparkSession, path: str) -> tuple[DataFrame, Header, codec.Codebook | None]:
    """Chunks, header and the shared codebook (None if each chunk has its own)."""
    register(spark)
    head = read_header(path)
    check_file(path, head)
    book = None
    if not head.book_each:
        n = codec.book_size(head.k, head.tile)
        book = codec.book_of_bytes(files.read_range(path, head.size, n), head.k, head.tile)
    return spark.read.format("qvol").load(path), head, book


# Stream chunks: four big-endian u16 (volume dimensions and count), payloads, then their u16 sizes.
STREAM_HEAD = ">4H"


def stream_chunk(dims: Dims, payloads: list[bytes]) -> bytes:
    for n in (*dims, len(payloads), *map(len, payloads)):
        if n > 65535:
            raise OptionError("stream chunks hold numbers up to 65535")
    return struct.pack(STREAM_HEAD, *dims, len(payloads)) + b"".join(payloads) + struct.pack(f">{len(payloads)}H", *map(len, payloads))


def parse_stream_chunk(data: bytes) -> tuple[Dims, list[bytes]]:
    """Dimensions and payloads; sizes are read from the end."""
    head = struct.calcsize(STREAM_HEAD)
    if len(data) < head:
        raise ValueError("a stream chunk is cut short")
    x, y, z, n = struct.unpack_from(STREAM_HEAD, data)
    sizes = struct.unpack_from(f">{n}H", data, len(data) - 2 * n)
    if head + sum(sizes) + 2 * n != len(data):
        raise ValueError("a stream chunk's sizes don't add up")
    at = head + np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    return Dims(x, y, z), [data[a:b] for a, b in zip(at[:-1], at[1:])]
