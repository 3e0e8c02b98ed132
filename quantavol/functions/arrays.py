"""Column functions over samples, planes and vectors. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantavol.options import U16_MAX, Metric


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unsigned16(v: Column | str) -> Column:
    """A signed 16-bit value as 0..65535."""
    return _c(v).cast("int").bitwiseAND(U16_MAX)


def checked16(v: Column | str) -> Column:
    """The value, or an error if it isn't in 0..65535."""
    v = _c(v)
    return F.when(v.between(0, U16_MAX), v.cast("int")).otherwise(F.raise_error(F.format_string("%s is no unsigned 16-bit value", v.cast("string"))))


def in_range16(v: Column | str) -> Column:
    return _c(v).between(0, U16_MAX)


def samples_of_bytes(b: Column | str, little: bool = False) -> Column:
    """Unsigned 16-bit samples of a binary column."""
    h = F.hex(_c(b))

    def sample(i: Column) -> Column:
        first, second = F.substr(h, i * 4 + 1, F.lit(2)), F.substr(h, i * 4 + 3, F.lit(2))
        return F.conv(F.concat(second, first) if little else F.concat(first, second), 16, 10).cast("int")

    n = (F.octet_length(_c(b)) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), sample)).otherwise(F.array().cast("array<int>"))


def bytes_of_samples(a: Column | str, little: bool = False) -> Column:
    """Binary of unsigned 16-bit samples, big-endian unless little."""

    def two(v: Column) -> Column:
        h = F.lpad(F.hex(v), 4, "0")
        return F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)) if little else h

    return F.unhex(F.array_join(F.transform(_c(a), two), ""))


def bytes_of_ints(a: Column | str, little: bool = False) -> Column:
    """Binary of signed 32-bit values, big-endian unless little."""

    def four(v: Column) -> Column:
        h = F.lpad(F.hex(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0")
        return F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))) if little else h

    return F.unhex(F.array_join(F.transform(_c(a), four), ""))


def difference(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def absolute(a: Column | str) -> Column:
    return F.transform(_c(a), F.abs)


def distance(a: Column | str, b: Column | str, metric: Metric = Metric.EUCLIDEAN) -> Column:
    """Distance of two vectors of one length, as a double."""
    d = F.transform(difference(a, b), lambda x: F.abs(x).cast("double"))
    if metric is Metric.MAX_DIFF:
        return F.array_max(d)
    if metric is Metric.MANHATTAN:
        return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def is_zero(vec: Column | str) -> Column:
    return F.forall(_c(vec), lambda x: x == 0)


def all_below_one(vec: Column | str) -> Column:
    return F.forall(_c(vec), lambda x: x < 1.0)


def holds(a: Column | str, value, up_to: int | None = None) -> Column:
    """Whether an array, or its first elements, has a value."""
    return F.array_contains(_c(a) if up_to is None else F.slice(_c(a), 1, up_to), value)


def linear_index(x: Column, y: Column, width: int, z: Column | None = None, plane: int = 0) -> Column:
    at = y * width + x
    return at if z is None else z * plane + at


def coordinates(p: Column, width: int, height: int | None = None) -> Column:
    """struct(x, y[, z]) of a linear index."""
    p = p.cast("long")
    x, rest = F.pmod(p, F.lit(width)), F.floor(p / width)
    if height is None:
        return F.struct(x.cast("int").alias("x"), rest.cast("int").alias("y"))
    return F.struct(x.cast("int").alias("x"), F.pmod(rest, F.lit(height)).cast("int").alias("y"), F.floor(rest / height).cast("int").alias("z"))


def add(a: Column, b: Column, *fields: str) -> Column:
    return F.struct(*((a[f] + b[f]).alias(f) for f in fields))


def subtract(a: Column, b: Column, *fields: str) -> Column:
    return F.struct(*((a[f] - b[f]).alias(f) for f in fields))


def product(a: Column, *fields: str) -> Column:
    out = F.lit(1).cast("long")
    for f in fields:
        out = out * a[f]
    return out


def sample_at(data: Column | str, x: Column, y: Column, width: int) -> Column:
    """A plane's sample at a place."""
    return F.element_at(_c(data), (y * width + x + 1).cast("int"))


def quantization_of(x: Column, y: Column, z: Column) -> Column:
    """Name of the quantization that a tile of these dimensions means."""
    return F.when(z > 1, "VECTOR_3D").when(y > 1, "VECTOR_2D").when(x > 1, "VECTOR_1D").otherwise("SCALAR")


def bits_of_size(k: Column) -> Column:
    return F.floor(F.log2(k)).cast("int")


def dims_of_text(s: Column) -> Column:
    """struct(x, y, z) of `A`, `AxB` or `AxBxC`; null where it is none of these."""
    parts = F.split(F.replace(s, F.lit(" "), F.lit("")), "x")
    part = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int")
    ok = F.regexp_like(F.replace(s, F.lit(" "), F.lit("")), F.lit("^[0-9]+(x[0-9]+){0,2}$"))
    return F.when(ok, F.struct(part(1).alias("x"), F.coalesce(part(2), F.lit(1)).alias("y"), F.coalesce(part(3), F.lit(1)).alias("z")))


def elapsed_text(ms: Column) -> Column:
    """H:MM:SS.mmm of milliseconds."""
    s = F.floor(ms / 1000)
    return F.format_string("%d:%02d:%02d.%03d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)), F.pmod(ms, F.lit(1000)))
