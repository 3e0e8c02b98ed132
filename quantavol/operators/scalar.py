"""Scalar quantization: Lloyd-Max training on histograms, and encoding by interval.

Training needs the histogram alone (at most 65,536 counts), so one distributed aggregate is
followed by a loop on the driver; with a codebook for each plane, every task trains on the planes
that it holds. Encoding is a binary search in the sorted boundaries; a value on a boundary goes to
the lower cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantavol.operators.tiling import list_column
from quantavol.options import U16_MAX

LEVELS = U16_MAX + 1
#: Updates of boundaries and centroids between two looks at the error, and the gain that goes on.
ROUNDS, LEAST_GAIN = 10, 1.0


class ScalarCodebook(NamedTuple):
    centroids: np.ndarray
    frequencies: np.ndarray

    @property
    def boundaries(self) -> np.ndarray:
        """Upper ends of all cells but the last: halfway between neighbours, rounded down."""
        return (self.centroids[1:] + self.centroids[:-1]) // 2

    def encode(self, values: np.ndarray) -> np.ndarray:
        """Codeword numbers of samples; the lower cell owns its upper boundary."""
        b = self.boundaries
        if (np.diff(b) >= 0).all():
            return np.searchsorted(b, values, side="left").astype(np.int32)
        return _first_cell(np.concatenate(([0], b, [U16_MAX])), np.asarray(values)).astype(np.int32)

    def decode(self, indices: np.ndarray) -> np.ndarray:
        return self.centroids[indices]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, int(c), int(f)) for i, (c, f) in enumerate(zip(self.centroids, self.frequencies))], "ix int, centroid int, freq long")

    @classmethod
    def of_rows(cls, rows: list) -> ScalarCodebook:
        rows = sorted(rows, key=lambda r: r["ix"])
        return cls(np.array([r["centroid"] for r in rows], dtype=np.int64), np.array([r["freq"] for r in rows], dtype=np.int64))


class Training(NamedTuple):
    """A trained codebook with its last boundaries and the log (iteration, mse, psnr)."""

    codebook: ScalarCodebook
    boundaries: np.ndarray
    log: list[tuple[int, float, float]]


def decibels(mse: float) -> float:
    return float("inf") if mse == 0 else float(10 * np.log10(U16_MAX**2 / mse))


def _first_cell(edges: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The first cell whose both ends hold a value, for edges in any order."""
    fits = (values[None, :] >= edges[:-1, None]) & (values[None, :] <= edges[1:, None])
    if not fits.any(axis=0).all():
        raise ValueError("a value lies in no cell")
    return fits.argmax(axis=0)


class LloydMax:
    """The state of a training run over a histogram."""

    def __init__(self, counts: np.ndarray, k: int, init: str = "offset"):
        if init not in ("offset", "reference"):
            raise ValueError("init is 'offset' or 'reference'")
        self.counts = np.zeros(LEVELS, dtype=np.int64)
        self.counts[: len(counts)] = counts
        self.values = np.flatnonzero(self.counts)
        if not len(self.values):
            raise ValueError("no samples to train on")
        self.k, self.low, self.high = k, int(self.values[0]), int(self.values[-1])
        # Sums over any interval of values are differences of running sums.
        self.mass = np.concatenate(([0], np.cumsum(self.counts)))
        self.moment = np.concatenate(([0], np.cumsum(self.counts * np.arange(LEVELS))))
        start = self.low if init == "offset" else 0
        width = (self.high - self.low) / k
        self.centroids = start + np.floor((np.arange(k) + 0.5) * width).astype(np.int64)
        self.edges = np.full(k + 1, self.high, dtype=np.int64)
        self.edges[0] = self.low
        self.frequencies = np.zeros(k, dtype=np.int64)

    def move_edges(self) -> None:
        self.edges[1:-1] = np.minimum(self.high, (self.centroids[1:] + self.centroids[:-1]) // 2)

    def start_at_modes(self) -> None:
        """Each centroid at the most frequent value between its edges, the smallest of equals."""
        for i, (a, b) in enumerate(pairwise(self.edges.tolist())):
            if b >= a and self.mass[b + 1] > self.mass[a]:
                self.centroids[i] = a + int(self.counts[a : b + 1].argmax())

    def move_centroids(self) -> None:
        """Means of the values between edges, both included, rounded down; empty cells stay."""
        a, b = self.edges[:-1], self.edges[1:]
        n, s = self.mass[b + 1] - self.mass[a], self.moment[b + 1] - self.moment[a]
        full = (b >= a) & (n > 0)
        self.centroids[full] = s[full] // n[full]

    def error(self) -> float:
        """Mean squared error; also counts how often each cell is used."""
        edges = self.edges
        if (np.diff(edges) >= 0).all():
            cell = np.searchsorted(edges[1:], self.values, side="left")
        else:
            cell = _first_cell(edges, self.values)
        n = self.counts[self.values]
        self.frequencies = np.bincount(cell, weights=n, minlength=self.k).astype(np.int64)
        d = self.values - self.centroids[cell]
        return float((n * d * d).sum() / n.sum())

    def train(self) -> Training:
        self.move_edges()
        self.start_at_modes()
        mse = self.error()
        log = [(0, mse, decibels(mse))]
        while True:
            for _ in range(ROUNDS):
                self.move_edges()
                self.move_centroids()
            before, mse = mse, self.error()
            log.append((len(log), mse, decibels(mse)))
            if before - mse < LEAST_GAIN:
                break
        return Training(ScalarCodebook(self.centroids.copy(), self.frequencies.copy()), self.edges.copy(), log)


def train_counts(counts: np.ndarray, k: int, init: str = "offset") -> Training:
    return LloydMax(counts, k, init).train()


def counts_of(planes: DataFrame) -> np.ndarray:
    """The histogram of all samples of planes: one for each task, summed in the executors; 65,536 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEVELS, dtype=np.int64)
        for b in batches:
            counts += np.bincount(b.column("data").flatten().to_numpy(zero_copy_only=False), minlength=LEVELS)
        v = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)), pa.array(counts[v])], names=["v", "n"])

    rows = planes.select("data").mapInArrow(run, "v int, n long").groupBy("v").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(LEVELS, dtype=np.int64)
    counts[rows["v"].to_numpy()] = rows["n"].to_numpy()
    return counts


def train(planes: DataFrame, k: int, init: str = "offset") -> Training:
    """One codebook for all planes."""
    return train_counts(counts_of(planes), k, init)


def train_each(planes: DataFrame, k: int, init: str = "offset") -> DataFrame:
    """(z, ix, centroid, freq): a codebook for each plane, trained where the plane is; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, z in enumerate(b.column("z").to_pylist()):
                data = b.column("data")[i].values.to_numpy(zero_copy_only=False)
                cb = train_counts(np.bincount(data, minlength=LEVELS), k, init).codebook
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, z, dtype=np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(cb.centroids.astype(np.int32)), pa.array(cb.frequencies)], names=["z", "ix", "centroid", "freq"])

    return planes.select("z", "data").mapInArrow(run, "z int, ix int, centroid int, freq long")


def log_frame(spark: SparkSession, log: list[tuple[int, float, float]]) -> DataFrame:
    return spark.createDataFrame(log, "iteration int, mse double, psnr double")


def encode_column(v: Column, boundaries: list[int]) -> Column:
    """Codeword number of a sample by sorted boundaries: how many of them it exceeds. JVM only."""
    if len(boundaries) <= 16:
        out = F.lit(0)
        for b in boundaries:
            out = out + (v > b).cast("int")
        return out
    return F.size(F.filter(F.array(*map(F.lit, boundaries)), lambda b: v > b))


def decode_column(ix: Column, centroids: list[int]) -> Column:
    return F.element_at(F.array(*map(F.lit, centroids)), ix + 1)


def cells(codebook: DataFrame) -> DataFrame:
    """(ix, centroid, lo, hi): a sample belongs to the cell with lo < v <= hi."""
    from pyspark.sql import Window

    w = Window.orderBy("ix")  # at most 256 rows
    half = lambda a, b: F.expr(f"({a} + {b}) div 2").cast("int")
    near = codebook.select("ix", "centroid", F.lag("centroid").over(w).alias("before"), F.lead("centroid").over(w).alias("after"))
    return near.select("ix", "centroid", F.coalesce(half("centroid", "before"), F.lit(-1)).alias("lo"), F.coalesce(half("centroid", "after"), F.lit(U16_MAX)).alias("hi"))


def encode_by_join(px: DataFrame, codebook: DataFrame) -> DataFrame:
    """Samples with ix and centroid by a range join; the codebook has at most 256 rows, so it is broadcast."""
    return px.join(F.broadcast(cells(codebook)), (F.col("v") > F.col("lo")) & (F.col("v") <= F.col("hi"))).drop("lo", "hi")


def encode_planes(planes: DataFrame, codebook: ScalarCodebook) -> DataFrame:
    """(z, data) with codeword numbers for samples."""
    return _map_planes(planes, codebook.encode)


def decode_planes(indices: DataFrame, codebook: ScalarCodebook) -> DataFrame:
    return _map_planes(indices, codebook.decode)


def quantize_planes(planes: DataFrame, codebook: ScalarCodebook) -> DataFrame:
    """Planes with each sample's centroid in its place."""
    return _map_planes(planes, lambda v: codebook.decode(codebook.encode(v)))


def _map_planes(planes: DataFrame, f) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = f(b.column("data")[i].values.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([b.column("z").slice(i, 1), list_column(data[None, :])], names=["z", "data"])

    return planes.select("z", "data").mapInArrow(run, "z int, data array<int>")


def lloyd_step(hist: DataFrame, codebook: DataFrame) -> DataFrame:
    """One update as a relational plan: new centroids as means over cells with both ends included."""
    lo_hi = cells(codebook).select("ix", "centroid", F.greatest(F.col("lo"), F.lit(0)).alias("lo"), "hi")
    inside = hist.join(F.broadcast(lo_hi), F.col("v").between(F.col("lo"), F.col("hi")))
    got = inside.groupBy("ix").agg(F.expr("sum(v * n) div sum(n)").cast("int").alias("moved"), F.sum("n").alias("n"))
    return lo_hi.join(got, "ix", "left").select("ix", F.coalesce("moved", "centroid").alias("centroid"), F.coalesce("n", F.lit(0)).alias("n"))


def mode_of_cells(hist: DataFrame, codebook: DataFrame) -> DataFrame:
    """The most frequent value of each cell, the smallest of equals."""
    lo_hi = cells(codebook).select("ix", F.greatest(F.col("lo"), F.lit(0)).alias("lo"), "hi")
    inside = hist.join(F.broadcast(lo_hi), F.col("v").between(F.col("lo"), F.col("hi")))
    return inside.groupBy("ix").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("mode"))
