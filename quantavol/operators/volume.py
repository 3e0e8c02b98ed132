"""Volumes as DataFrames: a row for each plane, or a row for each pixel.

Plane form is (z, data): z INT and the samples in row order. Pixel form is (z, y, x, v). Plane form
is for storage and for kernels over whole planes, pixel form for relational analysis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantavol.options import Dims, QuantOptions


def pixels(planes: DataFrame, dims: Dims) -> DataFrame:
    """Pixel form of planes. Samples beyond the plane's size don't count."""
    p = planes.select("z", F.posexplode("data").alias("p", "v")).filter(F.col("p") < dims.plane)
    return p.select("z", F.expr(f"p div {dims.x}").cast("int").alias("y"), F.expr(f"p % {dims.x}").cast("int").alias("x"), "v")


def planes_of(px: DataFrame, dims: Dims, blank: int = 0) -> DataFrame:
    """Plane form of pixels; places without a pixel are blank. One plane's pixels meet in a task."""
    at = (F.col("y") * dims.x + F.col("x")).cast("int")
    inside = px.filter(F.col("x").between(0, dims.x - 1) & F.col("y").between(0, dims.y - 1))
    got = inside.groupBy("z").agg(F.map_from_entries(F.collect_list(F.struct(at.alias("p"), F.col("v").alias("v")))).alias("m"))
    every = F.sequence(F.lit(0), F.lit(dims.plane - 1))
    return got.select("z", F.transform(every, lambda p: F.coalesce(F.try_element_at("m", p), F.lit(blank))).alias("data"))


def of_signal(df: DataFrame, z: Column, values: Column) -> DataFrame:
    """Plane form of array columns of doubles in -1..1, spread over 0..65535."""
    sample = lambda f: F.floor((f.cast("double") + 1.0) * 32767.5).cast("int")
    return df.select(z.cast("int").alias("z"), F.transform(values, sample).alias("data"))


def select_planes(df: DataFrame, plane: int | None = None, planes: tuple[int, int] | None = None) -> DataFrame:
    """Rows of one plane, of a range with both ends, or all. The predicate reaches Parquet scans."""
    if plane is not None:
        return df.filter(F.col("z") == plane)
    return df if planes is None else df.filter(F.col("z").between(*planes))


def select(df: DataFrame, options: QuantOptions) -> DataFrame:
    return select_planes(df, options.plane, options.planes)


def middle_plane(df: DataFrame, depth: int) -> DataFrame:
    return select_planes(df, depth // 2)


def training_rows(df: DataFrame, options: QuantOptions) -> DataFrame:
    return select_planes(df, planes=options.training_planes())


def inside(px: DataFrame, dims: Dims) -> DataFrame:
    """Pixels within a volume."""
    return px.filter(F.col("x").between(0, dims.x - 1) & F.col("y").between(0, dims.y - 1) & F.col("z").between(0, dims.z - 1))


def check_planes(planes: DataFrame, dims: Dims) -> DataFrame:
    """The planes; a plane of another size or a sample outside 0..65535 raises when it is read."""
    bad = (F.size("data") != dims.plane) | F.exists("data", lambda v: v.isNull() | (v < 0) | (v > 65535))
    checked = F.when(~bad, F.col("data")).otherwise(F.raise_error(F.concat(F.lit("plane "), F.col("z").cast("string"), F.lit(f" isn't {dims.x}x{dims.y} unsigned 16-bit samples"))))
    return planes.select("z", checked.alias("data"))


def as_signed_bits(planes: DataFrame) -> DataFrame:
    """Planes with samples read from signed 16-bit arrays taken as unsigned."""
    return planes.select("z", F.transform("data", lambda v: v.cast("int").bitwiseAND(65535)).alias("data"))
