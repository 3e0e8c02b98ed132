"""Tiles of planes and volumes as vectors, and back.

Tiles run in row order over the plane (or layer), samples in row order within a tile, stride = the
tile's width in both directions. Tiles that cross the edge follow the wrap rule. Vectors are rows
(z, vec_ix, vec); z is the plane, or for 3-D tiles the layer.

The index of every sample of every tile depends on the dimensions alone, so a task computes it once
and then gathers whole planes; nothing is exploded by sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantavol.options import Dims, Wrap

VECTORS = "z int, vec_ix long, vec array<int>"
#: Samples and layers that a group or a batch has at most, if one box isn't larger.
GROUP_SAMPLES, GROUP_LAYERS = 1 << 20, 256


def tile_counts(dims: Dims, tile: Dims) -> Dims:
    """Tiles along each axis."""
    return Dims(-(-dims.x // tile.x), -(-dims.y // tile.y), -(-dims.z // tile.z))


def wrapped(i: np.ndarray, size: int, wrap: Wrap) -> np.ndarray:
    """Source positions; -1 is blank. Mirrored: the last sample first, then backwards."""
    if wrap is Wrap.CLAMP:
        return np.minimum(i, size - 1)
    if wrap is Wrap.BLANK:
        return np.where(i < size, i, -1)
    return np.where(i < size, i, size - 1 - i % size)


def wrap_index(i: Column, size: int, wrap: Wrap = Wrap.MIRROR) -> Column:
    """The same rule as a column expression; null is blank."""
    if wrap is Wrap.CLAMP:
        return F.least(i, F.lit(size - 1))
    beyond = F.lit(None).cast("int") if wrap is Wrap.BLANK else F.lit(size - 1) - i % size
    return F.when(i < size, i).otherwise(beyond)


@lru_cache(maxsize=16)
def gather_index(dims: Dims, tile: Dims, wrap: Wrap) -> np.ndarray:
    """(tiles, samples of a tile): source positions in the box of `dims`; its size means blank."""
    n = tile_counts(dims, tile)
    axes = [wrapped(np.arange(c * t), size, wrap).reshape(c, t) for size, t, c in zip(dims, tile, n)]
    x, y, z = axes[0][None, None, :, None, None, :], axes[1][None, :, None, None, :, None], axes[2][:, None, None, :, None, None]
    at = (z * dims.y + y) * dims.x + x
    at = np.where((x < 0) | (y < 0) | (z < 0), dims.count, at)
    return at.reshape(n.count, tile.count)


def gather(box: np.ndarray, dims: Dims, tile: Dims, wrap: Wrap = Wrap.MIRROR) -> np.ndarray:
    """Vectors (tiles, samples) of a flat box of samples."""
    return np.append(box, np.zeros(1, dtype=box.dtype))[gather_index(dims, tile, wrap)]


def scatter(vectors: np.ndarray, dims: Dims, tile: Dims) -> np.ndarray:
    """The flat box that vectors tile, what lies beyond the edge cut off."""
    n = tile_counts(dims, tile)
    box = vectors.reshape(n.z, n.y, n.x, tile.z, tile.y, tile.x).transpose(0, 3, 1, 4, 2, 5)
    return box.reshape(n.z * tile.z, n.y * tile.y, n.x * tile.x)[: dims.z, : dims.y, : dims.x].reshape(-1)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=np.int32)


def list_column(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows.reshape(-1), dtype=np.int32)))


def vector_batch(*boxes: tuple[int, np.ndarray]) -> pa.RecordBatch:
    """The vectors of one or several planes or layers with their numbers."""
    z = np.repeat(np.array([z for z, _ in boxes], dtype=np.int32), [len(v) for _, v in boxes])
    ix = np.concatenate([np.arange(len(v), dtype=np.int64) for _, v in boxes])
    return pa.RecordBatch.from_arrays([pa.array(z), pa.array(ix), list_column(np.concatenate([v for _, v in boxes]))], names=["z", "vec_ix", "vec"])


def tile_planes(planes: DataFrame, dims: Dims, tile: Dims, wrap: Wrap = Wrap.MIRROR) -> DataFrame:
    """1-D and 2-D tiles of each plane. No shuffle. Small planes don't cost a batch each."""
    flat, box, most = Dims(tile.x, tile.y), Dims(dims.x, dims.y), GROUP_SAMPLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            data = b.column("data")
            for i, z in enumerate(b.column("z").to_pylist()):
                held.append((z, gather(data[i].values.to_numpy(zero_copy_only=False), box, flat, wrap)))
                size += held[-1][1].size
                if size >= most:
                    yield vector_batch(*held)
                    held, size = [], 0
        if held:
            yield vector_batch(*held)

    return planes.select("z", "data").mapInArrow(run, VECTORS)


def layer_count(depth: int, tile_z: int) -> int:
    """Layers of 3-D tiles: whole ones, the last takes the rest; one at least."""
    return max(1, depth // tile_z)


def layer_of(z: Column, depth: int, tile_z: int, first: int = 0) -> Column:
    return F.least(F.expr("1") * F.floor((z - first) / tile_z), F.lit(layer_count(depth, tile_z) - 1)).cast("int")


def layer_depth(layer: int, depth: int, tile_z: int) -> int:
    n = layer_count(depth, tile_z)
    return depth - (n - 1) * tile_z if layer == n - 1 else tile_z


def stacked(table: pa.Table) -> np.ndarray:
    """Planes of a group in order of z, as one flat box."""
    table = table.sort_by("z")
    return np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in table.column("data")])


def by_layers(planes: DataFrame, dims: Dims, tile_z: int, first: int, f: Callable[[int, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """f(layer, numbers of its planes, its flat box) of every layer. The planes of a layer, fewer than twice the tile's
    depth, meet in a task; neighbouring small layers are one group, as a group costs time of its own."""
    each = max(1, min(GROUP_LAYERS, GROUP_SAMPLES // (dims.plane * tile_z)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("layer", "ascending"), ("z", "ascending")])
        layers, z = table.column("layer").to_numpy(), table.column("z").to_numpy()
        data = pa.concat_arrays(table.column("data").chunks)
        samples, ends = data.values.to_numpy(zero_copy_only=False), data.offsets.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(layers)) + 1).tolist(), len(layers)]
        return pa.Table.from_batches([f(int(layers[a]), z[a:b], samples[ends[a] : ends[b]]) for a, b in pairwise(cuts)]).combine_chunks()

    layer = layer_of(F.col("z"), dims.z, tile_z, first)
    groups = planes.select("z", "data", layer.alias("layer")).groupBy(F.floor(F.col("layer") / each).alias("layers"))
    return groups.applyInArrow(run, schema)


def tile_layers(planes: DataFrame, dims: Dims, tile: Dims, wrap: Wrap = Wrap.MIRROR, first: int = 0) -> DataFrame:
    """3-D tiles of each layer."""

    def vectors(layer: int, z: np.ndarray, box: np.ndarray) -> pa.RecordBatch:
        return vector_batch((layer, gather(box, Dims(dims.x, dims.y, len(z)), tile, wrap)))

    return by_layers(planes, dims, tile.z, first, vectors, VECTORS)


def tiles(planes: DataFrame, dims: Dims, tile: Dims, wrap: Wrap = Wrap.MIRROR, first: int = 0) -> DataFrame:
    """Vectors of any kind of tile. first: the first selected plane, from which layers count."""
    return tile_layers(planes, dims, tile, wrap, first) if tile.z > 1 else tile_planes(planes, dims, tile, wrap)


def untile(vectors: DataFrame, dims: Dims, tile: Dims, first: int = 0) -> DataFrame:
    """Planes (z, data) of vectors: the inverse of tiles() for any wrap rule. One plane's or layer's
    vectors meet in a task."""

    def run(table: pa.Table) -> pa.Table:
        z = table.column("z")[0].as_py()
        vec = matrix(table.sort_by("vec_ix").column("vec"))
        depth = layer_depth(z, dims.z, tile.z) if tile.z > 1 else 1
        box = scatter(vec, Dims(dims.x, dims.y, depth), tile).reshape(depth, -1)
        zs = np.arange(depth) + (first + z * tile.z if tile.z > 1 else z)
        return pa.table({"z": pa.array(zs.astype(np.int32)), "data": list_column(box)})

    return vectors.groupBy("z").applyInArrow(run, "z int, data array<int>")
