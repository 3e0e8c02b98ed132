"""Files on any store that Arrow reaches: file, s3 and hdfs URIs, and local paths."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs

#: Bytes read or passed on at once, where items are smaller.
AT_ONCE = 4 << 20
#: Bytes that a commit puts together at once from short runs, and gaps between them that are read over.
WINDOW, NEAR = 32 << 20, 64 << 10


def partition_bytes(total: int) -> int:
    """Bytes of one partition: a 256th of all, but 8 MB at least, as each starts a reader, and 128 MB at most."""
    return min(128 << 20, max(8 << 20, total // 256))


def items_each(n: int, size: int) -> int:
    """Items of one partition, of n items of about `size` bytes. Small items cost time of their own, so a
    partition has a 64th of them at most, but may have 256."""
    return max(1, min(partition_bytes(n * size) // max(size, 1), max(256, -(-n // 64))))


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    for hadoop in ("s3a://", "s3n://"):
        if uri.startswith(hadoop):
            uri = "s3://" + uri[len(hadoop) :]
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    return pafs.FileSystem.from_uri(uri)


def size_of(uri: str) -> int:
    fs, path = locate(uri)
    info = fs.get_file_info(path)
    if info.type is not pafs.FileType.File:
        raise FileNotFoundError(uri)
    return info.size


def read_range(uri: str, at: int, n: int) -> bytes:
    fs, path = locate(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(n, at)


def read_all(uri: str) -> bytes:
    fs, path = locate(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def write_all(uri: str, parts) -> int:
    """Writes byte strings one after another; the bytes written."""
    fs, path = locate(uri)
    folder = path.rsplit("/", 1)[0]
    if folder:
        fs.create_dir(folder, recursive=True)
    n = 0
    with fs.open_output_stream(path) as f:
        for p in parts:
            f.write(p)
            n += len(p)
    return n


@dataclass
class Staged:
    """One task's file of items: their numbers and sizes in the order in which they stand there."""

    name: str
    numbers: np.ndarray
    sizes: np.ndarray


def stage(folder: str, items: Iterable[tuple[int, bytes]]) -> list[Staged]:
    """Writes a task's numbered items to one file of its own; no file without items."""
    name, numbers, sizes = f"{folder}/{uuid.uuid4().hex}", [], []

    def parts() -> Iterator[bytes]:
        for number, data in items:
            numbers.append(number)
            sizes.append(len(data))
            yield data

    every = parts()
    first = next(every, None)
    if first is None:
        return []
    write_all(name, (p for part in ([first], every) for p in part))
    return [Staged(name, np.array(numbers, dtype=np.int64), np.array(sizes, dtype=np.int64))]


class Joined:
    """Staged items in order of their numbers. Items that stand side by side in a file are read together."""

    def __init__(self, staged: list[Staged]):
        self.staged = staged
        sizes = np.concatenate([s.sizes for s in staged] or [np.zeros(0, dtype=np.int64)])
        numbers = np.concatenate([s.numbers for s in staged] or [np.zeros(0, dtype=np.int64)])
        owner = np.repeat(np.arange(len(staged)), [len(s.sizes) for s in staged])
        at = np.concatenate([np.cumsum(s.sizes) - s.sizes for s in staged] or [np.zeros(0, dtype=np.int64)])
        order = np.argsort(numbers, kind="stable")
        self.numbers, self.sizes, self.owner, self.at = numbers[order], sizes[order], owner[order], at[order]

    def data(self) -> Iterator[bytes]:
        if not len(self.sizes):
            return
        ends = self.at + self.sizes
        cuts = np.append(np.flatnonzero((self.owner[1:] != self.owner[:-1]) | (self.at[1:] != ends[:-1])) + 1, len(ends))
        begins = np.concatenate(([0], cuts[:-1]))
        who, at, n = self.owner[begins], self.at[begins], ends[cuts - 1] - self.at[begins]
        long, upto = np.append(np.flatnonzero(n >= AT_ONCE), len(n)), np.cumsum(n)
        i = 0
        while i < len(n):
            if n[i] >= AT_ONCE:
                yield from self._long(int(who[i]), int(at[i]), int(n[i]))
                i += 1
                continue
            j = min(int(np.searchsorted(upto, upto[i] - n[i] + WINDOW, side="right")), int(long[np.searchsorted(long, i)]))
            yield self._window(who[i:j], at[i:j], n[i:j])
            i = j

    def _read(self, file, who: int, at: int, n: int) -> bytes:
        data = file.read_at(n, at)
        if len(data) < n:
            raise OSError(f"{self.staged[who].name} is cut short")
        return data

    def _long(self, who: int, at: int, n: int) -> Iterator[bytes]:
        fs, path = locate(self.staged[who].name)
        with fs.open_input_file(path) as f:
            for i in range(at, at + n, AT_ONCE):
                yield self._read(f, who, i, min(AT_ONCE, at + n - i))

    def _window(self, who: np.ndarray, at: np.ndarray, n: np.ndarray) -> bytes:
        """Short runs of many files. Each file is opened once, and what stands there close together is read together."""
        to, out = np.cumsum(n) - n, bytearray(int(n.sum()))
        order = np.lexsort((n, at, who))
        who, at, n, to = who[order], at[order], n[order], to[order]
        for part in np.split(np.arange(len(who)), np.flatnonzero(np.diff(who)) + 1):
            owner = int(who[part[0]])
            fs, path = locate(self.staged[owner].name)
            with fs.open_input_file(path) as f:
                begin, data = 0, b""
                far = at[part] + n[part]
                for k, a, m, t in zip(part.tolist(), at[part].tolist(), n[part].tolist(), to[part].tolist()):
                    if a + m > begin + len(data):
                        # As far as gaps are short and the read stays bounded.
                        i = k - int(part[0])
                        last = i + int(np.searchsorted(far[i:], a + AT_ONCE, side="right")) - 1
                        gaps = np.flatnonzero(at[part[i + 1 : last + 1]] - far[i:last] > NEAR)
                        last = i + int(gaps[0]) if len(gaps) else last
                        begin, data = a, self._read(f, owner, a, int(far[last]) - a)
                    out[t : t + m] = data[a - begin : a - begin + m]
        return bytes(out)


def remove(uri: str) -> None:
    fs, path = locate(uri)
    info = fs.get_file_info(path)
    if info.type is pafs.FileType.Directory:
        fs.delete_dir(path)
    elif info.type is pafs.FileType.File:
        fs.delete_file(path)


def names_in(uri: str, suffix: str = "") -> list[str]:
    fs, path = locate(uri)
    if fs.get_file_info(path).type is not pafs.FileType.Directory:
        return []
    return sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(path)) if i.base_name.endswith(suffix))
