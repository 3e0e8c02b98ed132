"""Raw volumes: headerless unsigned 16-bit samples in order z, y, x, big-endian unless told.

`spark.read.format("u16raw")` gives the plane form: one partition for some planes, each read by a
seek; the option `planes` reads some planes only. (Filters aren't pushed to the reader: Spark 4.1
keeps a reader with its filters for later scans of one DataFrame that have none.) `df.write.format("u16raw")` writes one file: tasks write
their planes to a file each beside it, which the commit joins in order of z.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quantavol.operators.tiling import list_column
from quantavol.options import Dims, OptionError, parse_dims, parse_range
from quantavol.sources import files

PLANES = "z int, data array<int>"


def planes_text(text: str | None, depth: int) -> list[int]:
    """Plane numbers of an option: none, or `k` and `a-b` with both ends, separated by commas."""
    if not text:
        return list(range(depth))
    wanted: set[int] = set()
    for part in text.split(","):
        span = parse_range(part)
        wanted.update(range(span[0], span[1] + 1) if span else [int(part)])
    if min(wanted) < 0 or max(wanted) >= depth:
        raise OptionError(f"planes {text} are outside 0..{depth - 1}")
    return sorted(wanted)


def set_text(planes: list[int]) -> str:
    """A set of planes as an option: runs of neighbours as ranges."""
    at = sorted(set(planes))
    cuts = [i for i in range(len(at)) if not i or at[i] != at[i - 1] + 1]
    return ",".join(f"{at[i]}-{at[j - 1]}" for i, j in zip(cuts, [*cuts[1:], len(at)]))


def _runs(planes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Neighbours in a list of planes as (first, end), `most` planes at once."""
    begin = 0
    for i in range(1, len(planes) + 1):
        if i == len(planes) or planes[i] != planes[i - 1] + 1 or i - begin == most:
            yield planes[begin], planes[i - 1] + 1
            begin = i


@dataclass
class PlaneRange(InputPartition):
    planes: list[int]


class RawVolumeReader(DataSourceReader):
    def __init__(self, path: str, dims: Dims, planes: list[int], little: bool):
        self.path, self.dims, self.planes, self.little = path, dims, planes, little

    def partitions(self) -> list[PlaneRange]:
        each = files.items_each(len(self.planes), 2 * self.dims.plane)
        return [PlaneRange(self.planes[i : i + each]) for i in range(0, len(self.planes), each)] or [PlaneRange([])]

    def read(self, partition: PlaneRange) -> Iterator[pa.RecordBatch]:
        n = 2 * self.dims.plane
        fs, path = files.locate(self.path)
        if partition.planes:
            with fs.open_input_file(path) as f:
                for a, b in _runs(partition.planes, max(1, files.AT_ONCE // n)):
                    data = np.frombuffer(f.read_at((b - a) * n, a * n), dtype="<u2" if self.little else ">u2")
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b, dtype=np.int32)), list_column(data.astype(np.int32).reshape(b - a, -1))], names=["z", "data"])


@dataclass
class Written(WriterCommitMessage):
    parts: list[files.Staged]


class RawVolumeWriter(DataSourceArrowWriter):
    """kind: u2 or i4 samples."""

    def __init__(self, path: str, dtype: str, overwrite: bool):
        self.path, self.dtype, self.overwrite = path, dtype, overwrite
        self.staging = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        def planes() -> Iterator[tuple[int, bytes]]:
            for batch in iterator:
                for i, z in enumerate(batch.column("z").to_pylist()):
                    data = batch.column("data")[i].values.to_numpy(zero_copy_only=False)
                    if self.dtype.endswith("u2") and len(data) and (data.min() < 0 or data.max() > 65535):
                        raise ValueError(f"plane {z} has samples outside 0..65535")
                    yield z, data.astype(self.dtype).tobytes()

        return Written(files.stage(self.staging, planes()))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files.write_all(self.path, files.Joined([p for m in messages if m for p in m.parts]).data())
        files.remove(self.staging)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files.remove(self.staging)


class RawVolume(DataSource):
    """Options: path; dims `XxYxZ` (to read); planes `k` and `a-b`, separated by commas; endian big or little; sample u16 or i32 (to write)."""

    @classmethod
    def name(cls) -> str:
        return "u16raw"

    def schema(self) -> str:
        return PLANES

    def _little(self) -> bool:
        return self.options.get("endian", "big") == "little"

    def reader(self, schema: StructType) -> RawVolumeReader:
        dims = parse_dims(self.options.get("dims", ""))
        if dims is None:
            raise OptionError("option dims must be XxYxZ")
        path = self.options["path"]
        if (n := files.size_of(path)) != 2 * dims.count:
            raise OptionError(f"{path} has {n} bytes; {dims} unsigned 16-bit samples have {2 * dims.count}")
        return RawVolumeReader(path, dims, planes_text(self.options.get("planes"), dims.z), self._little())

    def writer(self, schema: StructType, overwrite: bool) -> RawVolumeWriter:
        order = "<" if self._little() else ">"
        return RawVolumeWriter(self.options["path"], order + ("i4" if self.options.get("sample") == "i32" else "u2"), overwrite)


def register(spark: SparkSession) -> None:
    """Makes `u16raw` known to a session."""
    spark.dataSource.register(RawVolume)


def read(spark: SparkSession, path: str, dims: Dims, planes: tuple[int, int] | list[int] | None = None) -> DataFrame:
    """Planes of a raw volume: all, a range (a tuple) with both ends, or a set (a list), of which alone the bytes are read."""
    register(spark)
    reader = spark.read.format("u16raw").option("dims", str(dims))
    if planes is None:
        return reader.load(path)
    if isinstance(planes, list) and not planes:
        return reader.option("planes", "0-0").load(path).limit(0)
    return reader.option("planes", set_text(planes) if isinstance(planes, list) else f"{planes[0]}-{planes[1]}").load(path)
