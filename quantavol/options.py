"""Options, enumerations and the small parsers of the command surface."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field
from enum import Enum, IntEnum
from math import log2
from typing import NamedTuple

U16_MAX = 65535


class Dims(NamedTuple):
    """Extent of a volume or of a tile."""

    x: int
    y: int = 1
    z: int = 1

    @property
    def plane(self) -> int:
        return self.x * self.y

    @property
    def count(self) -> int:
        return self.x * self.y * self.z

    def __str__(self) -> str:
        return f"{self.x}x{self.y}x{self.z}"


class Quantization(IntEnum):
    """Codes of the container format (fixed values)."""

    SCALAR = 0
    VECTOR_1D = 1
    VECTOR_2D = 2
    VECTOR_3D = 3
    INVALID = 255

    @classmethod
    def of_code(cls, code: int) -> Quantization:
        return cls(code) if code in cls._value2member_map_ else cls.INVALID

    @classmethod
    def of_tile(cls, tile: Dims | None) -> Quantization:
        """The kind of a tile by its largest used dimension; no tile means scalar."""
        if tile is None or tile.count <= 1:
            return cls.SCALAR
        if tile.z > 1:
            return cls.VECTOR_3D
        return cls.VECTOR_2D if tile.y > 1 else cls.VECTOR_1D

    def is_one_of(self, *others: Quantization) -> bool:
        return self in others


class Mode(str, Enum):
    """Where codebooks come from: each plane, the middle plane, or the whole selection (kept in a store)."""

    INDIVIDUAL = "individual"
    MIDDLE_PLANE = "middle"
    GLOBAL = "global"


class Wrap(str, Enum):
    """What stands beyond the volume's edge in a tile that crosses it."""

    BLANK = "blank"
    CLAMP = "clamp"
    MIRROR = "mirror"


class Metric(str, Enum):
    MANHATTAN = "manhattan"
    EUCLIDEAN = "euclidean"
    MAX_DIFF = "maxdiff"


class Method(str, Enum):
    COMPRESS = "compress"
    DECOMPRESS = "decompress"
    TRAIN = "train"
    INSPECT = "inspect"
    BENCHMARK = "benchmark"
    CUSTOM = "custom"
    HELP = "help"


class OptionError(ValueError):
    """All problems of a set of options at once."""


def parse_int(text: str) -> int | None:
    try:
        return int(text.replace(" ", ""))
    except ValueError:
        return None


def parse_dims(text: str) -> Dims | None:
    """`A`, `AxB` or `AxBxC` with positive numbers; spaces don't count."""
    parts = [parse_int(p) for p in text.replace(" ", "").split("x")]
    if not 1 <= len(parts) <= 3 or any(p is None or p < 1 for p in parts):
        return None
    return Dims(*parts)


def parse_range(text: str) -> tuple[int, int] | None:
    """`A-B`, both ends included; spaces don't count."""
    a, dash, b = text.replace(" ", "").partition("-")
    low, high = parse_int(a), parse_int(b)
    return (low, high) if dash and low is not None and high is not None and low <= high else None


def bits_of_size(k: int) -> int:
    return int(log2(k))


def elapsed(ms: int) -> str:
    """Milliseconds as hours, minutes, seconds and rest, leaving out leading zeros."""
    h, rest = divmod(ms, 3_600_000)
    m, rest = divmod(rest, 60_000)
    s, ms = divmod(rest, 1000)
    parts = [(h, "H"), (m, "min"), (s, "sec"), (ms, "ms")]
    first = next((i for i, (n, _) in enumerate(parts) if n), 3)
    return " ".join(f"{n} {unit}" for n, unit in parts[first:])


CONTAINER_SUFFIX, CODEBOOK_SUFFIX = ".QCMP", ".qvc"  # fixed values: file suffixes of the formats


def default_output(path: str, method: Method) -> str:
    """Where a command writes if it isn't told: the container's suffix is added or taken off."""
    if method is Method.COMPRESS:
        return path + CONTAINER_SUFFIX
    return path[: -len(CONTAINER_SUFFIX)] if path.upper().endswith(CONTAINER_SUFFIX) else path + ".raw"


@dataclass
class QuantOptions:
    """What to do with which planes; validate() reports every problem in one exception."""

    dims: Dims
    bits: int = 8
    tile: Dims | None = None
    mode: Mode = Mode.INDIVIDUAL
    plane: int | None = None
    planes: tuple[int, int] | None = None
    wrap: Wrap = Wrap.MIRROR
    store: str | None = None
    train_name: str = "volume"
    seed: int = 1
    init: str = "offset"
    verbose: bool = False
    worker_count: int | None = None  # Spark schedules; kept for callers that set it
    use_kd_tree: bool = False  # accepted and ignored: lookups are exhaustive over at most 256 codewords
    method: Method = Method.COMPRESS
    path: str | None = None
    output: str | None = None
    function: str = "plane_entropy"
    problems: list[str] = field(default_factory=list, repr=False)

    @property
    def kind(self) -> Quantization:
        return Quantization.of_tile(self.tile)

    @property
    def codebook_size(self) -> int:
        return 1 << self.bits

    @property
    def tile_dims(self) -> Dims:
        return self.tile or Dims(1)

    def selected(self) -> list[int]:
        """Plane numbers: one, a range with both ends, or all."""
        if self.plane is not None:
            return [self.plane]
        a, b = self.planes or (0, self.dims.z - 1)
        return list(range(a, b + 1))

    @property
    def plane_count(self) -> int:
        if self.plane is not None:
            return 1
        return self.planes[1] - self.planes[0] + 1 if self.planes else self.dims.z

    @property
    def middle_plane(self) -> int:
        return self.dims.z // 2

    def training_planes(self) -> tuple[int, int]:
        """First and last plane to train on: the middle one, the one, the range, or all, in this order."""
        if self.mode is Mode.MIDDLE_PLANE:
            return self.middle_plane, self.middle_plane
        if self.plane is not None:
            return self.plane, self.plane
        return self.planes or (0, self.dims.z - 1)

    def validate(self) -> QuantOptions:
        found = list(self.problems)
        if min(self.dims) < 1:
            found.append("volume dimensions must be positive")
        if not 1 <= self.bits <= 8:
            found.append("bits must be 1 to 8")
        if self.plane is not None and not 0 <= self.plane < self.dims.z:
            found.append(f"plane {self.plane} is outside 0..{self.dims.z - 1}")
        if self.planes and not 0 <= self.planes[0] <= self.planes[1] < self.dims.z:
            found.append(f"planes {self.planes} are outside 0..{self.dims.z - 1}")
        if self.kind is Quantization.VECTOR_3D and self.mode is not Mode.GLOBAL:
            found.append("3-D tiles need a global codebook")
        if found:
            raise OptionError("; ".join(found))
        return self

    def report(self) -> str:
        tile = "" if self.tile is None else f" {self.tile}"
        which = f"plane {self.plane}" if self.plane is not None else f"planes {self.planes[0]}-{self.planes[1]}" if self.planes else "all planes"
        return f"{self.method.value}: {self.kind.name.lower()}{tile}, {self.bits} bits, {self.mode.value} codebook, volume {self.dims}, {which}"

    @classmethod
    def from_args(cls, argv: list[str]) -> QuantOptions:
        """Options from a command line: -c, -d, -tcb, -i, -bench or -cf; -sq or -vq; -b, -mp, -cbc, -o, -v, -wc, -fn (a custom function's name); path, dims, planes."""
        p = argparse.ArgumentParser(add_help=False, prefix_chars="-")
        verb = p.add_mutually_exclusive_group()
        for flag, method in (("-c", Method.COMPRESS), ("-d", Method.DECOMPRESS), ("-tcb", Method.TRAIN), ("-i", Method.INSPECT), ("-bench", Method.BENCHMARK), ("-cf", Method.CUSTOM), ("-h", Method.HELP)):
            verb.add_argument(flag, dest="method", action="store_const", const=method)
        p.add_argument("-b", "--bits", default="8")
        p.add_argument("-sq", action="store_true")
        p.add_argument("-vq")
        p.add_argument("-mp", action="store_true")
        p.add_argument("-cbc")
        p.add_argument("-o")
        p.add_argument("-v", action="store_true")
        p.add_argument("-wc", type=int)
        p.add_argument("-fn", default="plane_entropy")
        p.add_argument("rest", nargs="*")
        a = p.parse_args(argv)
        problems = []
        method = a.method or Method.HELP
        bits = parse_int(a.bits)
        if bits is None:
            problems.append(f"bits: {a.bits!r} is no number")
        tile = parse_dims(a.vq) if a.vq else None
        if a.vq and tile is None:
            problems.append(f"tile: {a.vq!r} is no D, DxD or DxDxD")
        if method in (Method.COMPRESS, Method.TRAIN, Method.BENCHMARK) and not (a.sq or a.vq):
            problems.append("choose -sq or -vq")
        dims, plane, planes = Dims(1, 1, 1), None, None
        if len(a.rest) > 1:
            got = parse_dims(a.rest[1])
            dims = got or dims
            if got is None:
                problems.append(f"dimensions: {a.rest[1]!r}")
        if len(a.rest) > 2:
            planes = parse_range(a.rest[2])
            plane = parse_int(a.rest[2]) if planes is None else None
            if plane is None and planes is None:
                problems.append(f"planes: {a.rest[2]!r}")
        mode = Mode.MIDDLE_PLANE if a.mp else Mode.GLOBAL if a.cbc or method is Method.TRAIN else Mode.INDIVIDUAL
        path = a.rest[0] if a.rest else None
        if path is None and method is not Method.HELP:
            problems.append("no input")
        output = a.o or (default_output(path, method) if path else None)
        name = path.rsplit("/", 1)[-1] if path else "volume"
        store = a.o if method is Method.TRAIN else a.cbc
        return cls(dims, bits or 8, tile, mode, plane, planes, store=store, train_name=name, verbose=a.v, worker_count=a.wc, method=method, path=path, output=output, function=a.fn, problems=problems)
