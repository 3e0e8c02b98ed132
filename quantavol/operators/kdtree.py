"""A KD-tree over codewords with best-bin-first lookup.

Nodes split on the component of largest variance at its median, cut to an integer; components up to
the median go low. A lookup visits leaves in the order of their distance from the query, at most so
many; without a limit it is exact. With at most 256 codewords the matrix form in `vector` is faster;
this one is for codebooks with many components and a small number of visits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quantavol.operators.tiling import matrix


class Split(NamedTuple):
    dim: int
    at: int
    low: Split | np.ndarray
    high: Split | np.ndarray


def build(words: np.ndarray, bucket: int = 8) -> Split | np.ndarray:
    """The tree of codewords (rows); leaves are arrays of their numbers."""

    def node(rows: np.ndarray) -> Split | np.ndarray:
        if len(rows) <= bucket:
            return rows
        v = words[rows].astype(np.float64)
        dim = int(v.var(axis=0).argmax())
        at = int(np.median(v[:, dim]))
        low = words[rows, dim] <= at
        if low.all() or not low.any():
            return rows  # equal codewords, or a median at the largest: nothing to split
        return Split(dim, at, node(rows[low]), node(rows[~low]))

    return node(np.arange(len(words)))


def lookup(tree: Split | np.ndarray, words: np.ndarray, query: np.ndarray, most_leaves: int | None = None) -> tuple[int, int]:
    """(number, squared distance) of the nearest codeword found, the first of equals."""
    best, ties = (np.iinfo(np.int64).max, -1), 0
    heap: list[tuple[float, int, object]] = [(0.0, 0, tree)]
    leaves = 0
    while heap and (most_leaves is None or leaves < most_leaves):
        bound, _, node = heapq.heappop(heap)
        if bound > best[0]:
            break
        while isinstance(node, Split):
            d = int(query[node.dim]) - node.at
            near, far = (node.low, node.high) if d <= 0 else (node.high, node.low)
            ties += 1
            heapq.heappush(heap, (max(bound, float(d) * d), ties, far))
            node = near
        leaves += 1
        d2 = ((words[node].astype(np.int64) - query) ** 2).sum(axis=1)
        for number, distance in zip(node.tolist(), d2.tolist()):
            best = min(best, (distance, number))
    return best[1], best[0]


def assign(vecs: DataFrame, words: np.ndarray, most_leaves: int | None = None, bucket: int = 8) -> DataFrame:
    """vecs with ix and d2 of the codeword that the tree finds."""
    tree = build(words, bucket)
    names = [c for c in vecs.columns if c not in ("ix", "d2")]
    schema = ", ".join(f"`{c}` {vecs.schema[c].dataType.simpleString()}" for c in names) + ", ix int, d2 double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [lookup(tree, words, v, most_leaves) for v in matrix(b.column("vec")).astype(np.int64)]
            ix, d2 = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ix, type=pa.int32()), pa.array(map(float, d2), type=pa.float64())], names=[*names, "ix", "d2"])

    return vecs.select(*names).mapInArrow(run, schema)
