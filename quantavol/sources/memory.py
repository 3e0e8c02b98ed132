"""Volumes from memory, from a function, and from image files."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantavol.operators.tiling import list_column
from quantavol.options import Dims
from quantavol.sources.raw import PLANES


def from_plane_buffers(spark: SparkSession, buffers: list[np.ndarray], first: int = 0) -> DataFrame:
    """Planes from one array each; signed 16-bit arrays are taken as unsigned."""
    if not buffers:
        return spark.createDataFrame([], PLANES)
    rows = np.stack([_unsigned(b).reshape(-1) for b in buffers])
    return spark.createDataFrame(pa.table({"z": pa.array(np.arange(len(rows), dtype=np.int32) + first), "data": list_column(rows)}), PLANES)


def from_flat_buffer(spark: SparkSession, buffer: np.ndarray, dims: Dims) -> DataFrame:
    """Planes of one array over the whole volume, in order z, y, x."""
    if buffer.size != dims.count:
        raise ValueError(f"{buffer.size} samples for a volume of {dims}")
    return from_plane_buffers(spark, list(_unsigned(buffer).reshape(dims.z, dims.plane)))


def _unsigned(a: np.ndarray) -> np.ndarray:
    if a.dtype == np.int16:
        return a.view(np.uint16).astype(np.int32)
    if a.dtype.kind not in "iu":
        raise ValueError("only unsigned 16-bit samples are supported")
    if a.size and (a.min() < 0 or a.max() > 65535):
        raise ValueError("samples outside 0..65535")
    return a.astype(np.int32)


def from_expression(spark: SparkSession, dims: Dims, value: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Pixels (z, y, x, v) of an expression of columns x, y and z; made where they are used."""
    at = spark.range(dims.count)
    z, y, x = (F.expr(e).cast("int") for e in (f"id div {dims.plane}", f"(id % {dims.plane}) div {dims.x}", f"id % {dims.x}"))
    return at.select(z.alias("z"), y.alias("y"), x.alias("x")).withColumn("v", value(F.col("x"), F.col("y"), F.col("z")).cast("int"))


def from_callback(spark: SparkSession, dims: Dims, value: Callable[[pd.Series, pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """Planes of a function over arrays of x, y and z, called once a plane in the executors."""
    y, x = np.divmod(np.arange(dims.plane), dims.x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z in b.column("z").to_pylist():
                v = np.asarray(value(pd.Series(x), pd.Series(y), pd.Series(np.full(dims.plane, z)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([z], type=pa.int32()), list_column(v[None, :])], names=["z", "data"])

    return spark.range(dims.z).select(F.col("id").cast("int").alias("z")).mapInArrow(run, PLANES)


# Fixed values of the image formats: TIFF tags and type sizes.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "offsets", 277: "samples", 278: "strip_rows", 279: "lengths"}
TYPE_SIZE = {1: 1, 3: 2, 4: 4}


def read_tiff(data: bytes) -> list[np.ndarray]:
    """Pages (height, width) of an uncompressed TIFF of one 16-bit sample a pixel."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF file")
    pages, at = [], struct.unpack_from(order + "I", data, 4)[0]
    while at:
        n = struct.unpack_from(order + "H", data, at)[0]
        page = {"compression": [1], "samples": [1]}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if tag in TAGS and kind in TYPE_SIZE:
                place = at + 10 + 12 * i
                if count * TYPE_SIZE[kind] > 4:
                    place = struct.unpack_from(order + "I", data, place)[0]
                page[TAGS[tag]] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, place))
        if page["compression"] != [1] or page["samples"] != [1] or page.get("bits") != [16]:
            raise ValueError("only uncompressed TIFF pages of one 16-bit sample a pixel are supported")
        raw = b"".join(data[o : o + k] for o, k in zip(page["offsets"], page["lengths"]))
        pages.append(np.frombuffer(raw, dtype=order + "u2").reshape(page["height"][0], page["width"][0]))
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    return pages


def read_pgm(data: bytes) -> list[np.ndarray]:
    """The image of a binary PGM of 16 bits."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(data[at:end])
        at = end
    if fields[0] != b"P5" or int(fields[3]) <= 255:
        raise ValueError("only binary PGM of 16 bits is supported")
    w, h = int(fields[1]), int(fields[2])
    return [np.frombuffer(data, dtype=">u2", count=w * h, offset=at + 1).reshape(h, w)]


def read_image(data: bytes) -> list[np.ndarray]:
    return read_pgm(data) if data[:2] == b"P5" else read_tiff(data)


def from_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, z, x, y, data): the pages of TIFF and PGM files, with their size in each row.

    Pages of a file count from 0. Files are read whole, one a row: they are images, not volumes of
    many gigabytes; those are better kept raw.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                for z, page in enumerate(read_image(content)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), *(pa.array([v], type=pa.int32()) for v in (z, page.shape[1], page.shape[0])), list_column(page.reshape(1, -1).astype(np.int32))],
                        names=["path", "z", "x", "y", "data"],
                    )

    found = spark.read.format("binaryFile").load(path).select("path", "content")
    return found.mapInArrow(run, "path string, z int, x int, y int, data array<int>")


def volume_of_images(images: DataFrame) -> tuple[DataFrame, Dims]:
    """Planes and dimensions of the pages of one file, or of one-page files in order of their names.

    All pages must have one size.
    """
    from pyspark.sql import Window

    facts = images.agg(F.min("x").alias("x"), F.max("x").alias("x2"), F.min("y").alias("y"), F.max("y").alias("y2"), F.count(F.lit(1)).alias("z"), F.countDistinct("path").alias("files")).first()
    if not facts["z"] or facts["x"] != facts["x2"] or facts["y"] != facts["y2"]:
        raise ValueError("no images, or images of different sizes")
    dims = Dims(facts["x"], facts["y"], facts["z"])
    if facts["files"] == 1:
        return images.select("z", "data"), dims
    # A number for each page; what is sorted in one task are names and page numbers alone.
    order = images.select("path", "z").withColumn("n", (F.row_number().over(Window.orderBy("path", "z")) - 1).cast("int"))
    return images.join(order, ["path", "z"]).select(F.col("n").alias("z"), "data"), dims
