"""Vectorised words, hashes and line features over Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8 keeps those bytes out of
multi-byte characters, so working on bytes equals working on code points. Null texts count as
empty. Every function works on slices of bounded bytes; one longer text forms a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 20
MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (multiply, shift, exclusive-or)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n pseudo-random 64-bit values, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 20)) * np.uint64(_BASE))


BYTE_CODE = seeds(256, 1) | np.uint64(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i mod 2^64 for i < n."""
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


class Words(NamedTuple):
    """Words of several texts. data: the bytes; doc_at: offsets of texts; start, end: of each word;
    first: for each text the number of words before it (one more entry than texts)."""

    data: np.ndarray
    doc_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most so many bytes together (one row at least)."""
    _, at = flat_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def split_words(column: pa.Array, lower: bool = False) -> Words:
    """All words of a slice of texts."""
    data, at = flat_bytes(column)
    if lower and len(data):
        data = LOWER[data]
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(data, at, none, none, np.zeros(len(at), dtype=np.int64))
    word = ~IS_SPACE[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    inner = at[:-1][at[:-1] < len(data)]
    before[inner] = False
    start = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    last = at[1:][at[1:] > 0] - 1
    after[last] = False
    end = np.flatnonzero(word & ~after) + 1
    return Words(data, at, start, end, np.searchsorted(start, at))


#: Bytes whose prefix sums are held at once.
HASHED = SLICE_BYTES // 2


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans: equal bytes give equal hashes wherever they stand.

    Starts and ends must ascend. From prefix sums over HASHED bytes at a time; a longer span is summed piece by piece.
    """
    up, down = _powers(HASHED + 1)
    out, i, n = np.empty(len(start), dtype=np.uint64), 0, len(start)
    with np.errstate(over="ignore"):
        while i < n:
            low = int(start[i])
            j = int(np.searchsorted(end, low + HASHED, side="right"))
            if j <= i:
                total, step, stop = np.uint64(0), np.uint64(1), int(end[i])
                for at in range(low, stop, HASHED):
                    piece = data[at : min(at + HASHED, stop)]
                    total = total + step * np.sum(BYTE_CODE[piece] * up[: len(piece)], dtype=np.uint64)
                    step = step * up[HASHED]
                out[i] = mix(np.array([total + np.uint64(stop - low)]))[0]
                i += 1
                continue
            piece = data[low : end[j - 1]]
            prefix = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(BYTE_CODE[piece] * up[: len(piece)], out=prefix[1:])
            a, z = start[i:j] - low, end[i:j] - low
            out[i:j] = mix((prefix[z] - prefix[a]) * down[a] + (z - a).astype(np.uint64))
            i = j
    return out


def word_hashes(w: Words) -> np.ndarray:
    """Hashes of all words."""
    return span_hashes(w.data, w.start, w.end)


def gram_hashes(h: np.ndarray, n: int, salt: int = 7) -> np.ndarray:
    """Hashes of all runs of n consecutive values, across texts too; len(h) - n + 1 values."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mult = seeds(2, salt) | np.uint64(1)
        out, have, power = h.copy(), 1, mult[0]
        # Doubling: a run of 2k values is a run of k values times the power, plus the next run of k.
        parts = [(h, 1, mult[0])]
        while have * 2 <= n:
            out = out[: len(out) - have] * power + out[have:]
            have, power = have * 2, power * power
            parts.append((out, have, power))
        total, done = None, 0
        for part, k, p in reversed(parts):
            if done + k <= n:
                piece = part[done:]
                total = piece if total is None else total[: len(piece)] * p + piece[: len(total)]
                done += k
        return mix(total[: len(h) - n + 1] + np.uint64(n))


def whole_gram_mask(first: np.ndarray, n: int) -> np.ndarray:
    """For the runs of gram_hashes over all words: whether a run lies within one text."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, dtype=bool)
    ends = np.repeat(first[1:], np.diff(first))[: total - n + 1]
    return np.arange(total - n + 1) + n <= ends


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + length."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
