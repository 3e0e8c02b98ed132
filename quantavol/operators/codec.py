"""Whole codecs: volumes to coded chunks and back.

A chunk is a plane, or for 3-D tiles a layer. Tiling, quantizing and packing of a chunk are one step
in the task that holds its planes; only 3-D tiles shuffle, by layer. With a codebook for each
plane, training is part of the same step. Chunks are rows (chunk, n_bytes, payload[, book]).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantavol.operators import scalar, tiling, vector, volume
from quantavol.operators.huffman import HuffmanCode
from quantavol.options import Dims, Mode, OptionError, Quantization, QuantOptions
from quantavol.sources import files

Codebook = scalar.ScalarCodebook | vector.VectorCodebook
CHUNKS = "chunk int, n_bytes long, payload binary"
CHUNKS_WITH_BOOKS = CHUNKS + ", book binary"
#: Small chunks that make a batch.
MOST_ROWS = 4096


# Codebooks as they stand in containers: codewords as big-endian u16, then counts as big-endian i64.


def book_bytes(book: Codebook) -> bytes:
    words = book.centroids if isinstance(book, scalar.ScalarCodebook) else book.vectors
    return np.asarray(words).astype(">u2").tobytes() + np.asarray(book.frequencies).astype(">i8").tobytes()


def book_size(k: int, tile: Dims | None) -> int:
    return k * (2 * (tile.count if tile else 1) + 8)


def book_of_bytes(data: bytes, k: int, tile: Dims | None) -> Codebook:
    width = tile.count if tile else 1
    if len(data) < book_size(k, tile):
        raise ValueError("the codebook is cut short")
    words = np.frombuffer(data, dtype=">u2", count=k * width).astype(np.int64)
    counts = np.frombuffer(data, dtype=">i8", count=k, offset=2 * k * width).astype(np.int64)
    return vector.VectorCodebook(words.reshape(k, width), counts, tile) if tile else scalar.ScalarCodebook(words, counts)


def train(planes: DataFrame, options: QuantOptions) -> Codebook:
    """One codebook for the training planes of the options."""
    rows = volume.training_rows(planes, options)
    first = options.training_planes()[0]
    if options.tile is None:
        return scalar.train(rows, options.codebook_size, options.init).codebook
    vecs = tiling.tiles(rows, _depth(options, rows), options.tile, options.wrap, first)
    return vector.train(vecs, options.codebook_size, options.tile, options.seed).codebook


def _depth(options: QuantOptions, rows: DataFrame | None = None) -> Dims:
    a, b = options.training_planes() if rows is not None else (options.selected()[0], options.selected()[-1])
    return Dims(options.dims.x, options.dims.y, b - a + 1)


def compress(planes: DataFrame, options: QuantOptions, book: Codebook | None = None) -> DataFrame:
    """Coded chunks of the selected planes; with a codebook for each plane, also the books."""
    options.validate()
    chosen = volume.select(planes, options).select("z", "data")
    first = options.selected()[0]
    if options.mode is Mode.INDIVIDUAL:
        return _compress_each(chosen, options, first)
    book = book or train(planes, options)
    return encode(chosen, options, book, first)


def encode(chosen: DataFrame, options: QuantOptions, book: Codebook, first: int = 0) -> DataFrame:
    """Coded chunks by a given codebook."""
    code = HuffmanCode(book.frequencies)
    dims, tile, wrap = options.dims, options.tile, options.wrap
    if options.kind is Quantization.VECTOR_3D:

        def layer(number: int, z: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
            box = Dims(dims.x, dims.y, len(z))
            return _chunk_batch([(number, code.encode(book.encode(tiling.gather(data, box, tile, wrap))), None)])

        return tiling.by_layers(chosen, Dims(dims.x, dims.y, _depth(options).z), tile.z, first, layer, CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _chunk_batches((z - first, code.encode(book.encode(_vectors(data, dims, tile, wrap))), None) for z, data in _planes(batches))

    return chosen.mapInArrow(run, CHUNKS)


def compress_raw(spark: SparkSession, options: QuantOptions, book: Codebook | None = None, little: bool = False) -> DataFrame:
    """compress() of the raw volume at options.path: the task that codes a chunk reads its planes, which
    lie side by side in the file, so samples never pass through rows, and 3-D tiles need no shuffle."""
    options.validate()
    if options.mode is not Mode.INDIVIDUAL and book is None:
        raise OptionError("a codebook is missing")
    dims, tile, wrap, k = options.dims, options.tile, options.wrap, options.codebook_size
    path, init, seed, first, selected = options.path, options.init, options.seed, options.selected()[0], _depth(options)
    if (size := files.size_of(path)) != 2 * dims.count:
        raise OptionError(f"{path} has {size} bytes; {dims} unsigned 16-bit samples have {2 * dims.count}")
    code = HuffmanCode(book.frequencies) if book is not None else None
    deep = tile.z if tile and tile.z > 1 else 1
    chunks = tiling.layer_count(selected.z, deep) if deep > 1 else selected.z
    tasks = -(-chunks // files.items_each(chunks, -(-2 * selected.count // chunks)))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, bytes | None]]:
        fs, place = files.locate(path)
        with fs.open_input_file(place) as file:
            for batch in batches:
                for number in batch.column("id").to_pylist():
                    box = chunk_dims(number, selected, tile)
                    raw = file.read_at(2 * box.count, 2 * dims.plane * (first + number * deep))
                    data = np.frombuffer(raw, dtype="<u2" if little else ">u2").astype(np.int32)
                    vecs = data if tile is None else tiling.gather(data, box, tile, wrap)
                    if code is not None:
                        yield number, code.encode(book.encode(vecs)), None
                    else:
                        own = _train_plane(vecs, k, tile, init, seed)
                        yield number, HuffmanCode(own.frequencies).encode(own.encode(vecs)), book_bytes(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _chunk_batches(coded(batches))

    return spark.range(0, chunks, 1, tasks).mapInArrow(run, CHUNKS if code is not None else CHUNKS_WITH_BOOKS)


def _compress_each(chosen: DataFrame, options: QuantOptions, first: int) -> DataFrame:
    k, dims, tile, wrap = options.codebook_size, options.dims, options.tile, options.wrap
    init, seed = options.init, options.seed

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, bytes]]:
        for z, data in _planes(batches):
            vecs = _vectors(data, dims, tile, wrap)
            book = _train_plane(vecs, k, tile, init, seed)
            yield z - first, HuffmanCode(book.frequencies).encode(book.encode(vecs)), book_bytes(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _chunk_batches(coded(batches))

    return chosen.mapInArrow(run, CHUNKS_WITH_BOOKS)


class _PlaneVectors(vector.TrainingSet):
    """A training set of one plane, in the task that holds it."""

    def __init__(self, vecs: np.ndarray, seed: int):
        distinct, first, weight = np.unique(vecs, axis=0, return_index=True, return_counts=True)
        order = np.argsort(first, kind="stable")
        vectors = distinct[order].astype(np.int64)
        self.local, self.distinct, self.width, self.seed = (vectors, weight[order], vector.member_hash(vectors, seed)), len(distinct), vecs.shape[1], seed

    def close(self) -> None:
        pass


def _train_plane(vecs: np.ndarray, k: int, tile: Dims | None, init: str, seed: int) -> Codebook:
    if tile is None:
        return scalar.train_counts(np.bincount(vecs, minlength=scalar.LEVELS), k, init).codebook
    return vector.train_on(_PlaneVectors(vecs, seed), k, tile, seed).codebook


def train_sizes(planes: DataFrame, options: QuantOptions, bits: list[int]) -> dict[int, Codebook]:
    """train() for each of several bits; samples or vectors are counted once."""
    rows, tile = volume.training_rows(planes, options), options.tile
    if tile is None:
        counts = scalar.counts_of(rows)
        return {b: scalar.train_counts(counts, 1 << b, options.init).codebook for b in bits}
    data = vector.TrainingSet(tiling.tiles(rows, _depth(options, rows), tile, options.wrap, options.training_planes()[0]), tile.count, options.seed)
    try:
        found = vector.train_sizes(data, [1 << b for b in bits], tile, options.seed)
    finally:
        data.close()
    return {b: found[1 << b] for b in bits}


def _train_plane_sizes(vecs: np.ndarray, bits: list[int], tile: Dims | None, init: str, seed: int) -> dict[int, Codebook]:
    if tile is None:
        return {b: _train_plane(vecs, 1 << b, None, init, seed) for b in bits}
    found = vector.train_sizes(_PlaneVectors(vecs, seed), [1 << b for b in bits], tile, seed)
    return {b: found[1 << b] for b in bits}


GRID = "tile string, mode string, bits int, z int, abs_sum long, sq_sum long, n long"


def grid_sums(planes: DataFrame, options: QuantOptions, bits: list[int], modes: list[Mode]) -> DataFrame:
    """(tile, mode, bits, z, abs_sum, sq_sum, n): each plane is coded to payloads and back by every mode and number of
    bits in the task that holds it (3-D tiles: its layer). Codebooks that planes share are trained before."""
    dims, tile, wrap, init, seed = options.dims, options.tile, options.wrap, options.init, options.seed
    name = "scalar" if tile is None else str(tile)
    shared: dict[tuple[str, int], tuple[Codebook, HuffmanCode]] = {}
    for mode in modes:
        if mode is not Mode.INDIVIDUAL:
            found = train_sizes(planes, QuantOptions(dims, bits[0], tile, mode, seed=seed), bits)
            shared.update({(mode.value, b): (book, HuffmanCode(book.frequencies)) for b, book in found.items()})
    each, deep = Mode.INDIVIDUAL in modes, bool(tile and tile.z > 1)
    names = [m.value for m in modes]

    def cells(z: np.ndarray, data: np.ndarray) -> Iterator[tuple]:
        box = Dims(dims.x, dims.y, len(z))
        flat = tile if deep or tile is None else Dims(tile.x, tile.y)
        vecs = data if tile is None else tiling.gather(data, box, flat, wrap)
        own = _train_plane_sizes(vecs, bits, tile, init, seed) if each else {}
        for mode in names:
            for b in bits:
                book, code = shared.get((mode, b)) or (own[b], HuffmanCode(own[b].frequencies))
                values = book.decode(code.decode(code.encode(book.encode(vecs)), len(vecs)))
                off = (data - (tiling.scatter(values, box, flat) if tile else values)).astype(np.int64).reshape(len(z), -1)
                for at, d in zip(z.tolist(), off):
                    yield name, mode, b, at, int(np.abs(d).sum()), int((d * d).sum()), len(d)

    def table(rows: list[tuple]) -> pa.Table:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({f.split()[0]: pa.array(c, type=k) for f, c, k in zip(GRID.split(", "), zip(*rows), kinds)})

    if deep:

        def layer(t: pa.Table) -> pa.Table:
            return table(list(cells(np.sort(t.column("z").to_numpy()), tiling.stacked(t))))

        layers = tiling.layer_of(F.col("z"), _depth(options).z, tile.z, options.selected()[0]).alias("layer")
        return planes.select("z", "data", layers).groupBy("layer").applyInArrow(layer, GRID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for z, data in _planes(batches):
            yield from table(list(cells(np.array([z]), data))).to_batches()

    # Work on a plane takes much longer than its bytes tell, so planes are dealt anew.
    tasks = 4 * planes.sparkSession.sparkContext.defaultParallelism
    return planes.select("z", "data").repartition(tasks, "z").mapInArrow(run, GRID)


def _planes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for b in batches:
        for i, z in enumerate(b.column("z").to_pylist()):
            yield z, b.column("data")[i].values.to_numpy(zero_copy_only=False)


def _vectors(data: np.ndarray, dims: Dims, tile: Dims | None, wrap) -> np.ndarray:
    return data if tile is None else tiling.gather(data, Dims(dims.x, dims.y), Dims(tile.x, tile.y), wrap)


def _chunk_batches(chunks: Iterator[tuple[int, bytes, bytes | None]]) -> Iterator[pa.RecordBatch]:
    """(chunk, payload, book) as batches of some megabytes; small chunks don't cost a batch each."""
    held, size = [], 0
    for c in chunks:
        held.append(c)
        size += len(c[1]) + len(c[2] or b"")
        if size >= files.AT_ONCE or len(held) >= MOST_ROWS:
            yield _chunk_batch(held)
            held, size = [], 0
    if held:
        yield _chunk_batch(held)


def _chunk_batch(held: list[tuple[int, bytes, bytes | None]]) -> pa.RecordBatch:
    numbers, payloads, books = zip(*held)
    out = {"chunk": pa.array(numbers, type=pa.int32()), "n_bytes": pa.array([len(p) for p in payloads], type=pa.int64()), "payload": pa.array(payloads, type=pa.binary())}
    return pa.RecordBatch.from_pydict(out | ({"book": pa.array(books, type=pa.binary())} if books[0] is not None else {}))


def chunk_dims(number: int, dims: Dims, tile: Dims | None) -> Dims:
    """The box that a chunk of a volume of `dims` (its selected planes) holds."""
    depth = tiling.layer_depth(number, dims.z, tile.z) if tile and tile.z > 1 else 1
    return Dims(dims.x, dims.y, depth)


def decompress(chunks: DataFrame, dims: Dims, tile: Dims | None, k: int, book: Codebook | None = None, first: int = 0) -> DataFrame:
    """Planes (z, data) of chunks; dims: of the selected planes, which count from `first`.

    book: shared by all chunks; without it each chunk brings its own (column book). Chunks are
    decoded where they are. A payload that ends early raises.
    """
    if book is None and "book" not in chunks.columns:
        raise ValueError("no codebook: neither shared nor in the chunks")
    shared = HuffmanCode(book.frequencies) if book is not None else None

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            for i, number in enumerate(b.column("chunk").to_pylist()):
                own = book if book is not None else book_of_bytes(b.column("book")[i].as_py(), k, tile)
                code = shared or HuffmanCode(own.frequencies)
                box = chunk_dims(number, dims, tile)
                n = tiling.tile_counts(box, tile).count if tile else box.count
                values = own.decode(code.decode(b.column("payload")[i].as_py(), n))
                flat = tiling.scatter(values, box, tile) if tile else values
                z = first + (number * tile.z if tile and tile.z > 1 else number) + np.arange(box.z)
                yield z, flat.reshape(box.z, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for z, rows in decoded(batches):
            held.append((z, rows))
            size += rows.size * 4
            if size >= files.AT_ONCE or len(held) >= MOST_ROWS:
                yield _plane_batch(held)
                held, size = [], 0
        if held:
            yield _plane_batch(held)

    wanted = ["chunk", "payload"] + (["book"] if book is None else [])
    return chunks.select(*wanted).mapInArrow(run, "z int, data array<int>")


def _plane_batch(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    zs, rows = (np.concatenate(x) for x in zip(*held))
    return pa.RecordBatch.from_arrays([pa.array(zs.astype(np.int32)), tiling.list_column(rows)], names=["z", "data"])


def quantize(planes: DataFrame, options: QuantOptions, book: Codebook) -> DataFrame:
    """Planes as they come back from coding and decoding, without packing."""
    if options.tile is None:
        return scalar.quantize_planes(volume.select(planes, options), book)
    first = options.selected()[0]
    dims = _depth(options)
    vecs = tiling.tiles(volume.select(planes, options), dims, options.tile, options.wrap, first)
    words = book.vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ix, _ = vector.nearest(tiling.matrix(b.column("vec")), words)
            yield pa.RecordBatch.from_arrays([b.column("z"), b.column("vec_ix"), tiling.list_column(words[ix])], names=["z", "vec_ix", "vec"])

    return tiling.untile(vecs.mapInArrow(run, tiling.VECTORS), dims, options.tile, first)


def expected_bytes(chunks: DataFrame, k: int, tile: Dims | None, each: bool) -> int:
    """Bytes of a container's body: payloads and codebooks, header not counted."""
    row = chunks.agg(F.sum("n_bytes").alias("n"), F.count(F.lit(1)).alias("c")).first()
    return (row["n"] or 0) + book_size(k, tile) * (row["c"] if each else 1)


def codebook_frame(spark: SparkSession, book: Codebook) -> DataFrame:
    return book.frame(spark)
