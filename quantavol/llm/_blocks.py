"""Messages between blocks of documents and hash parts: arrays packed into bytes."""

from __future__ import annotations

import numpy as np
import zstandard

MESSAGE = "block long, part int, body binary"


def squeeze(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays one after another, compressed."""
    raw = b"".join([np.array([len(arrays), *(a.nbytes for a in arrays)], dtype="<i8").tobytes(), *(a.tobytes() for a in arrays)])
    return zstandard.ZstdCompressor(level=level).compress(raw)


def spread(body: bytes, *dtypes: str) -> list[np.ndarray]:
    """The arrays of squeeze(), given their types."""
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
    sizes = np.frombuffer(raw, dtype="<i8", count=n, offset=8)
    at, out = 8 * (n + 1), []
    for size, dtype in zip(sizes.tolist(), dtypes):
        out.append(np.frombuffer(raw, dtype=dtype, count=size // np.dtype(dtype).itemsize, offset=at))
        at += size
    return out


def gaps(ascending: np.ndarray) -> np.ndarray:
    """Ascending values as steps, which take fewer bytes when compressed."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def ungap(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


def planes(values: np.ndarray, width: int = 4) -> np.ndarray:
    """Unsigned values of so many bytes as planes of bytes, the lowest first: upper ones are mostly zero."""
    return np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).reshape(-1)


def unplane(data: np.ndarray, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(width, -1).T).reshape(-1).view(f"<u{width}")


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of ascending keys by part, and offsets of the parts."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))
