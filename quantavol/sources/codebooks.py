"""The codebook store: trained codebooks as a partitioned table, and the binary codebook files.

A codebook's key is (training name, kind, size, tile). Keys are partition columns, so a look-up
prunes to one small file; saving a key again replaces it alone.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantavol.operators.codec import Codebook
from quantavol.operators.scalar import ScalarCodebook
from quantavol.operators.vector import VectorCodebook
from quantavol.options import CODEBOOK_SUFFIX, Dims, OptionError, Quantization, bits_of_size
from quantavol.sources import files

SCHEMA = "ix int, word array<int>, freq long, train_name string, quantizer string, k int, tile string"
KEYS = ("train_name", "quantizer", "k", "tile")

# Fixed values of the file format: mark, kind, size and name length; then name, tile, codewords, counts.
MAGIC = b"QCMPCACHE"
FIXED = ">9sBHH"
TILE = ">3H"


def _tile_of(book: Codebook) -> Dims | None:
    return book.tile if isinstance(book, VectorCodebook) else None


def _tile_name(tile: Dims | None) -> str:
    return "none" if tile is None else str(tile)


def save(spark: SparkSession, store: str, train_name: str, book: Codebook) -> None:
    tile = _tile_of(book)
    words = book.vectors if tile else np.asarray(book.centroids)[:, None]
    rows = [(i, [int(x) for x in w], int(f)) for i, (w, f) in enumerate(zip(words, book.frequencies))]
    key = (train_name, Quantization.of_tile(tile).name.lower(), len(rows), _tile_name(tile))
    df = spark.createDataFrame([(*r, *key) for r in rows], SCHEMA).coalesce(1)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(store)


def rows(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(store)


def keys(spark: SparkSession, store: str) -> DataFrame:
    """(train_name, quantizer, k, tile) of every codebook of a store; only names of folders are read."""
    return rows(spark, store).select(*KEYS).distinct()


def _of_key(spark: SparkSession, store: str, train_name: str, k: int, tile: Dims | None) -> DataFrame:
    key = {"train_name": train_name, "quantizer": Quantization.of_tile(tile).name.lower(), "k": k, "tile": _tile_name(tile)}
    out = rows(spark, store)
    for name, value in key.items():
        out = out.filter(F.col(name) == value)
    return out


def exists(spark: SparkSession, store: str, train_name: str, k: int, tile: Dims | None = None) -> bool:
    if not _has(spark, store):
        return False
    return not _of_key(spark, store, train_name, k, tile).select("ix").isEmpty()


def _has(spark: SparkSession, store: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path))


def load(spark: SparkSession, store: str, train_name: str, k: int, tile: Dims | None = None) -> Codebook | None:
    """The codebook of a key, or None; at most 256 rows."""
    if not _has(spark, store):
        return None
    got = sorted(_of_key(spark, store, train_name, k, tile).select("ix", "word", "freq").collect(), key=lambda r: r["ix"])
    if not got:
        return None
    words, freq = np.array([r["word"] for r in got], dtype=np.int64), np.array([r["freq"] for r in got], dtype=np.int64)
    return VectorCodebook(words, freq, tile) if tile else ScalarCodebook(words[:, 0], freq)


def available(spark: SparkSession, store: str, train_name: str, tile: Dims | None = None) -> list[int]:
    """Bits for which the store has a codebook."""
    if not _has(spark, store):
        return []
    name = Quantization.of_tile(tile).name.lower()
    found = rows(spark, store).filter((F.col("train_name") == train_name) & (F.col("quantizer") == name) & (F.col("tile") == _tile_name(tile))).select("k").distinct().collect()
    return sorted(bits_of_size(r["k"]) for r in found)


def load_or_train(spark: SparkSession, store: str, train_name: str, k: int, tile: Dims | None, train) -> Codebook:
    """The stored codebook, or the one that train() gives, which is then stored."""
    book = load(spark, store, train_name, k, tile)
    if book is None:
        book = train()
        save(spark, store, train_name, book)
    return book


def file_name(train_name: str, k: int, tile: Dims | None) -> str:
    return f"{train_name}_{k}_bits{CODEBOOK_SUFFIX}" if tile is None else f"{train_name}_{k}_{tile}{CODEBOOK_SUFFIX}"


def expected_size(name_length: int, k: int, tile: Dims | None) -> int:
    return struct.calcsize(FIXED) + name_length + struct.calcsize(TILE) + k * (8 + 2 * (tile.count if tile else 1))


def file_bytes(train_name: str, book: Codebook) -> bytes:
    tile, name = _tile_of(book), train_name.encode()
    words = book.vectors if tile else book.centroids
    k = len(book.frequencies)
    head = struct.pack(FIXED, MAGIC, int(Quantization.of_tile(tile)), k, len(name)) + name + struct.pack(TILE, *(tile or (0, 0, 0)))
    return head + np.asarray(words).astype(">u2").tobytes() + np.asarray(book.frequencies).astype(">i8").tobytes()


def of_file_bytes(data: bytes) -> tuple[str, Codebook]:
    """Training name and codebook of a codebook file."""
    n = struct.calcsize(FIXED)
    if len(data) < n or data[: len(MAGIC)] != MAGIC:
        raise OptionError("no codebook file: the mark is missing")
    _, kind, k, name_length = struct.unpack_from(FIXED, data)
    if Quantization.of_code(kind) is Quantization.INVALID:
        raise OptionError("no codebook file: unknown quantization")
    name = data[n : n + name_length].decode()
    six = struct.unpack_from(TILE, data, n + name_length)
    tile = Dims(*six) if kind != Quantization.SCALAR else None
    if len(data) != expected_size(name_length, k, tile):
        raise OptionError(f"a codebook file of {len(data)} bytes; {expected_size(name_length, k, tile)} are expected")
    at = n + name_length + struct.calcsize(TILE)
    width = tile.count if tile else 1
    words = np.frombuffer(data, dtype=">u2", count=k * width, offset=at).astype(np.int64)
    freq = np.frombuffer(data, dtype=">i8", count=k, offset=at + 2 * k * width).astype(np.int64)
    return name, VectorCodebook(words.reshape(k, width), freq, tile) if tile else ScalarCodebook(words, freq)


def export_file(folder: str, train_name: str, book: Codebook) -> str:
    path = f"{folder.rstrip('/')}/{file_name(train_name, len(book.frequencies), _tile_of(book))}"
    files.write_all(path, [file_bytes(train_name, book)])
    return path


def import_file(path: str) -> tuple[str, Codebook]:
    return of_file_bytes(files.read_all(path))


def files_in(folder: str) -> list[str]:
    return files.names_in(folder, CODEBOOK_SUFFIX)


def describe(name: str, book: Codebook, verbose: bool = False) -> str:
    tile, k = _tile_of(book), len(book.frequencies)
    lines = [f"kind: {Quantization.of_tile(tile).name.lower()}", f"trained on: {name}", f"codewords: {k} ({bits_of_size(k)} bits)", f"tile: {tile or 'none'}", f"bytes: {expected_size(len(name.encode()), k, tile)}"]
    if verbose:
        words = book.vectors if tile else book.centroids
        lines += [f"{i}: {np.asarray(w).tolist()} x {int(f)}" for i, (w, f) in enumerate(zip(words, book.frequencies))]
    return "\n".join(lines)
