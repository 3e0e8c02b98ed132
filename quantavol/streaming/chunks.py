"""Coding as a stream: the codebook is loaded once, chunks are independent and need no state.

A stream of planes (from any streaming source) becomes a stream of coded chunks, and a stream of
chunks becomes planes, with the same steps as batches. 3-D tiles need all planes of a layer, so
there each stream row is a whole box.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quantavol.operators import codec, tiling
from quantavol.operators.huffman import HuffmanCode
from quantavol.options import Dims, QuantOptions, Wrap
from quantavol.sources import files
from quantavol.sources.container import parse_stream_chunk, stream_chunk

T = TypeVar("T")
BOXES = "id long, x int, y int, z int, data array<int>"


def encode_planes(planes: DataFrame, options: QuantOptions, book: codec.Codebook) -> DataFrame:
    """A stream (or batch) of planes as chunks; scalar and 1-D or 2-D tiles."""
    if options.tile and options.tile.z > 1:
        raise ValueError("3-D tiles need boxes: see encode_boxes")
    return codec.encode(planes.select("z", "data"), options, book)


def decode_planes(chunks: DataFrame, dims: Dims, tile: Dims | None, k: int, book: codec.Codebook) -> DataFrame:
    return codec.decompress(chunks, dims, tile, k, book)


def encode_box(data: np.ndarray, dims: Dims, tile: Dims | None, book: codec.Codebook, code: HuffmanCode, wrap: Wrap = Wrap.MIRROR) -> bytes:
    """A box of planes as one self-contained stream chunk."""
    payloads = []
    if tile and tile.z > 1:
        layers, at = tiling.layer_count(dims.z, tile.z), 0
        for i in range(layers):
            box = Dims(dims.x, dims.y, tiling.layer_depth(i, dims.z, tile.z))
            payloads.append(code.encode(book.encode(tiling.gather(data[at : at + box.count], box, tile, wrap))))
            at += box.count
    else:
        for plane in data.reshape(dims.z, dims.plane):
            values = plane if tile is None else tiling.gather(plane, Dims(dims.x, dims.y), Dims(tile.x, tile.y), wrap)
            payloads.append(code.encode(book.encode(values)))
    return stream_chunk(dims, payloads)


def decode_box(body: bytes, tile: Dims | None, book: codec.Codebook, code: HuffmanCode) -> tuple[Dims, np.ndarray]:
    dims, payloads = parse_stream_chunk(body)
    out = []
    for i, payload in enumerate(payloads):
        box = codec.chunk_dims(i, dims, tile)
        n = tiling.tile_counts(box, tile).count if tile else box.count
        values = book.decode(code.decode(payload, n))
        out.append(tiling.scatter(values, box, tile) if tile else values)
    return dims, np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _at_once(items: Iterator[tuple[int, T, int]]) -> Iterator[tuple[int, list[T]]]:
    """(number, item, bytes) in lists of some megabytes with the number of the first; small boxes don't cost a batch each."""
    held, size, first = [], 0, 0
    for i, item, n in items:
        first = first if held else i
        held.append(item)
        size += n
        if size >= files.AT_ONCE or len(held) >= codec.MOST_ROWS:
            yield first, held
            held, size = [], 0
    if held:
        yield first, held


def encode_boxes(boxes: DataFrame, tile: Dims | None, book: codec.Codebook, wrap: Wrap = Wrap.MIRROR) -> DataFrame:
    """(id, n_bytes, body) of a stream of boxes (id, x, y, z, data)."""
    code = HuffmanCode(book.frequencies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = zip(*(b.column(c).to_pylist() for c in "xyz"))
            coded = ((k, body, len(body)) for k, body in ((i, encode_box(b.column("data")[i].values.to_numpy(zero_copy_only=False), Dims(*d), tile, book, code, wrap)) for i, d in enumerate(sizes)))
            for first, bodies in _at_once(coded):
                yield pa.RecordBatch.from_arrays([b.column("id").slice(first, len(bodies)), pa.array([len(x) for x in bodies], type=pa.int64()), pa.array(bodies, type=pa.binary())], names=["id", "n_bytes", "body"])

    return boxes.select("id", "x", "y", "z", "data").mapInArrow(run, "id long, n_bytes long, body binary")


def decode_boxes(chunks: DataFrame, tile: Dims | None, book: codec.Codebook) -> DataFrame:
    """Boxes (id, x, y, z, data) of a stream of chunks (id, body)."""
    code = HuffmanCode(book.frequencies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            boxes = ((i, x, 4 * len(x[1])) for i, x in enumerate(decode_box(body, tile, book, code) for body in b.column("body").to_pylist()))
            for first, held in _at_once(boxes):
                ends = np.cumsum([0, *(len(x) for _, x in held)]).astype(np.int32)
                data = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x for _, x in held]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(first, len(held)), *(pa.array(v, type=pa.int32()) for v in zip(*(d for d, _ in held))), data], names=["id", *"xyz", "data"])

    return chunks.select("id", "body").mapInArrow(run, BOXES)


def write_stream(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], available_now: bool = True) -> StreamingQuery:
    """Starts a stream into a sink for micro-batches; the checkpoint must be on a shared store."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_parquet_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a stream into Parquet files, each micro-batch exactly once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_levels(events: DataFrame, codebook: list[int], late: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Counts of codewords of a signal (ts, value) by window: value * 100 is quantized by boundaries."""
    from quantavol.operators.scalar import encode_column

    ts = F.col("ts").cast("timestamp")
    ix = encode_column(F.floor(F.col("value") * 100), codebook).alias("ix")
    rows = events.select(ts.alias("ts"), ix)
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    w = F.window("ts", width)
    return rows.groupBy(w.alias("w"), "ix").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "ix", "n")
