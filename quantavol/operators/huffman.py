"""Huffman codes over at most 256 symbols, and packing of index streams.

Codes are built on the driver from the symbol counts. Streams are packed most significant bit
first and padded with zeros to whole bytes, chunk by chunk. Of two equally likely nodes the one
that was made first is taken first; the total of coded bits doesn't depend on that.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Symbols that are decoded bit by bit, at once and by one code in all, before tables of windows pay.
SHORT, WALKED = 4096, 16384


class HuffmanCode:
    """Codes of symbols 0 .. k - 1. Symbols of count 0 have codes too; a lone symbol takes one bit."""

    def __init__(self, counts: Sequence[int]):
        if not len(counts):
            raise ValueError("no symbols")
        if min(counts) < 0:
            raise ValueError("negative count")
        self.counts = [int(c) for c in counts]
        self._windows: Windows | None = None
        self._walked = 0
        heap: list[tuple[int, int, object]] = [(c, s, s) for s, c in enumerate(self.counts)]
        heapq.heapify(heap)
        made = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            # The rarer branch is marked 1.
            heapq.heappush(heap, (a[0] + b[0], made, (b[2], a[2])))
            made += 1
        self.tree = heap[0][2]
        self.codes: list[str] = [""] * len(self.counts)
        walk = [(self.tree, "")]
        while walk:
            node, code = walk.pop()
            if isinstance(node, tuple):
                walk += [(node[0], code + "0"), (node[1], code + "1")]
            else:
                self.codes[node] = code or "0"
        self.lengths = np.array([len(c) for c in self.codes], dtype=np.int64)
        longest = int(self.lengths.max())
        self.bits = np.zeros((len(self.codes), longest), dtype=np.uint8)
        for s, c in enumerate(self.codes):
            self.bits[s, : len(c)] = np.frombuffer(c.encode(), dtype=np.uint8) - 48

    @property
    def total_bits(self) -> int:
        return int(sum(n * int(l) for n, l in zip(self.counts, self.lengths)))

    def encode(self, symbols: np.ndarray) -> bytes:
        used = np.arange(self.bits.shape[1])[None, :] < self.lengths[symbols][:, None]
        return np.packbits(self.bits[symbols][used]).tobytes()

    def tables(self) -> Windows:
        """What every window of 16 bits starts with; made once."""
        if self._windows is None:
            self._windows = _windows(self)
        return self._windows

    def decode(self, payload: bytes, n: int) -> np.ndarray:
        """n symbols; an early end raises.

        The payload is cut into segments that are followed side by side, each from its first bit, whether
        or not a code begins there: such a walk soon falls in with the true one. The segments are
        then joined in order: from where the walk before ends, windows are followed one by one
        until the segment's walk is met. Each step takes all whole codes of the next 16 bits.
        """
        if self._windows is None and n <= SHORT and self._walked < WALKED:
            self._walked += n
            return self._walk(payload, n)
        t, bits = self.tables(), 8 * len(payload)
        raw = np.frombuffer(payload + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
        words = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
        segments = max(1, min(512, bits >> 11))
        starts = np.arange(segments, dtype=np.int64) * bits // segments
        stops = np.append(starts[1:], bits)
        walks: list[np.ndarray] = []
        here, live = starts.copy(), np.arange(segments if segments > 1 else 0)
        met = np.zeros(bits + 1, dtype=bool)
        while len(live):
            p = here[live]
            met[p] = True
            step = t.bits[(words[p >> 3] >> (8 - (p & 7)).astype(np.uint32)) & 0xFFFF]
            # Codes of more than 16 bits end a walk; joining goes on from there.
            here[live] = p + step
            live = live[(step > 0) & (here[live] < stops[live])]
            walks.append(p)
        order = np.sort(np.concatenate(walks)) if walks else np.zeros(0, dtype=np.int64)
        cut = np.searchsorted(order, np.append(starts, bits))
        word, steps = memoryview(words), t.bits.tobytes()
        pieces: list[np.ndarray] = []
        long: list[tuple[int, int]] = []  # (bit, symbol)
        at = 0
        for s in range(segments):
            stop, alone = int(stops[s]), []
            while at < stop:
                if met[at] and at >= starts[s]:
                    i = int(np.searchsorted(order[cut[s] : cut[s + 1]], at)) + int(cut[s])
                    walk = order[i : cut[s + 1]]
                    pieces += [np.array(alone, dtype=np.int64), walk]
                    alone, at = [], int(here[s])
                    if at >= stop or at != walk[-1]:
                        continue
                    pieces[-1] = walk[:-1]
                step = steps[word[at >> 3] >> (8 - (at & 7)) & 0xFFFF]
                alone.append(at)
                if step:
                    at += step
                    continue
                node, begin = self.tree, at
                while isinstance(node, tuple):
                    if at >= bits:
                        break
                    node = node[payload[at >> 3] >> (7 - (at & 7)) & 1]
                    at += 1
                if isinstance(node, tuple):
                    alone.pop()
                    at = bits
                    break
                long.append((begin, node))
            pieces.append(np.array(alone, dtype=np.int64))
        places = np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.int64)
        found = (words[places >> 3] >> (8 - (places & 7)).astype(np.uint32)) & 0xFFFF
        rows, taken = t.symbols[found], t.counts[found].astype(np.int64)
        if long:
            i = np.searchsorted(places, [b for b, _ in long])
            rows[i, 0], taken[i] = [s for _, s in long], 1
        out = rows[np.arange(rows.shape[1])[None, :] < taken[:, None]][:n].astype(np.int32)
        if len(out) < n or int(self.lengths[out].sum()) > bits:
            raise ValueError("the payload ends before its last symbol")
        return out

    def _walk(self, payload: bytes, n: int) -> np.ndarray:
        """decode() of a short payload, without tables, which take longer to make than some thousand symbols."""
        bits = np.unpackbits(np.frombuffer(payload, dtype=np.uint8)).tolist()
        out: list[int] = []
        if not isinstance(self.tree, tuple):
            out = [self.tree] * min(n, len(bits))
        elif n:
            node = self.tree
            for b in bits:
                node = node[b]
                if not isinstance(node, tuple):
                    out.append(node)
                    if len(out) == n:
                        break
                    node = self.tree
        if len(out) < n:
            raise ValueError("the payload ends before its last symbol")
        return np.array(out, dtype=np.int32)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s, c, len(c)) for s, c in enumerate(self.codes)], "symbol int, code string, len int")

    def probabilities(self) -> list[tuple[int, float]]:
        """(symbol, share) from the most frequent on, equal ones by symbol."""
        total = max(sum(self.counts), 1)
        return sorted(((s, c / total) for s, c in enumerate(self.counts)), key=lambda x: (-x[1], x[0]))


class Windows(NamedTuple):
    """For every window of 16 bits: how many whole codes it starts with, their bits together, and their symbols."""

    counts: np.ndarray
    bits: np.ndarray
    symbols: np.ndarray


def _windows(code: HuffmanCode) -> Windows:
    width = 16
    one_symbol, one_length = np.zeros(1 << width, dtype=np.int16), np.zeros(1 << width, dtype=np.int64)
    for s, c in enumerate(code.codes):
        if len(c) <= width:
            low = int(c, 2) << (width - len(c))
            one_symbol[low : low + (1 << (width - len(c)))] = s
            one_length[low : low + (1 << (width - len(c)))] = len(c)
    every = np.arange(1 << width)
    most = width // int(code.lengths.min())
    counts, used = np.zeros(1 << width, dtype=np.int64), np.zeros(1 << width, dtype=np.int64)
    symbols = np.zeros((1 << width, most), dtype=np.int16)
    live = np.ones(1 << width, dtype=bool)
    for k in range(most):
        rest = (every << used) & 0xFFFF
        live &= (one_length[rest] > 0) & (used + one_length[rest] <= width)
        symbols[live, k] = one_symbol[rest[live]]
        used[live] += one_length[rest[live]]
        counts[live] += 1
    return Windows(counts.astype(np.uint8), used.astype(np.uint8), symbols)


def write_fixed(values: Sequence[int], width: int) -> bytes:
    """Values of a fixed width, the least significant bit of each first."""
    v = np.asarray(values, dtype=np.uint64)
    return np.packbits(((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)).tobytes()


def read_fixed(payload: bytes, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(payload, dtype=np.uint8))
    if len(bits) < n * width:
        raise ValueError("the payload ends before its last value")
    return (bits[: n * width].reshape(n, width).astype(np.int64) << np.arange(width)).sum(axis=1)


def total_bits(counts: DataFrame, code: DataFrame, *by: str) -> DataFrame:
    """Coded bits and bytes of symbol counts (by..., ix, n) by a join with the code table (256 rows at most)."""
    joined = counts.join(F.broadcast(code), F.col("ix") == F.col("symbol"))
    return joined.groupBy(*by).agg(F.sum(F.col("n") * F.col("len")).alias("bits")).withColumn("n_bytes", F.expr("(bits + 7) div 8"))
