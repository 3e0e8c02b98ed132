"""Vector quantization: LBG training and nearest codewords.

Equal training vectors are counted first. Small sets of different vectors are trained on the
driver; larger ones stay distributed as blocks of samples, and each LBG iteration is one pass that assigns
vectors and adds up per-codeword sums in the executors; what comes back is those sums, from few tasks.

Distances are Euclidean; squared distances of unsigned 16-bit vectors are exact in doubles, and the
first of equally near codewords wins.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantavol.functions.arrays import distance
from quantavol.operators.scalar import decibels
from quantavol.operators.tiling import list_column, matrix
from quantavol.options import U16_MAX, Dims, Metric

#: Relative gains in distortion below which a refinement ends: while splitting, and at the end.
SPLIT_EPS, FINE_EPS = 0.005, 0.0005
SPREAD_SHARE = 4.0
#: Different vectors (times their length) up to which training runs on the driver.
LOCAL_SAMPLES = 4_000_000
MOST_ROUNDS = 100


class VectorCodebook(NamedTuple):
    vectors: np.ndarray
    frequencies: np.ndarray
    tile: Dims

    def encode(self, vecs: np.ndarray) -> np.ndarray:
        return nearest(vecs, self.vectors)[0].astype(np.int32)

    def decode(self, indices: np.ndarray) -> np.ndarray:
        return self.vectors[indices]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, [int(x) for x in v], int(f)) for i, (v, f) in enumerate(zip(self.vectors, self.frequencies))], "ix int, vec array<int>, freq long")

    @classmethod
    def of_rows(cls, rows: list, tile: Dims) -> VectorCodebook:
        rows = sorted(rows, key=lambda r: r["ix"])
        return cls(np.array([r["vec"] for r in rows], dtype=np.int64), np.array([r["freq"] for r in rows], dtype=np.int64), tile)


class Training(NamedTuple):
    codebook: VectorCodebook
    mse: float
    psnr: float
    log: list[tuple[int, int, float]]  # (codebook size, iteration, mean distortion)


def nearest(vecs: np.ndarray, codebook: np.ndarray, at_once: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest codeword of each vector, the first of equals."""
    c = codebook.astype(np.float64)
    norm = (c * c).sum(axis=1)
    ix, d2 = np.zeros(len(vecs), dtype=np.int64), np.zeros(len(vecs))
    step = max(1, at_once // max(len(c), 1))
    for i in range(0, len(vecs), step):
        v = vecs[i : i + step].astype(np.float64)
        score = norm[None, :] - 2 * (v @ c.T)
        best = score.argmin(axis=1)
        ix[i : i + step] = best
        d2[i : i + step] = score[np.arange(len(v)), best] + (v * v).sum(axis=1)
    return ix, d2


class Sums(NamedTuple):
    """Per codeword: vectors, distances and squared distances, component sums, least and largest
    components, and one member chosen by a seeded hash."""

    n: np.ndarray
    dist: np.ndarray
    sq: np.ndarray
    total: np.ndarray
    low: np.ndarray
    high: np.ndarray
    pick: np.ndarray
    member: np.ndarray

    @property
    def centroids(self) -> np.ndarray:
        """Means, halves rounded up; zero for codewords without vectors."""
        n = np.maximum(self.n, 1)[:, None]
        return (2 * self.total + n) // (2 * n)

    @property
    def spread(self) -> np.ndarray:
        return (self.high - self.low) / SPREAD_SHARE


def member_hash(vecs: np.ndarray, seed: int) -> np.ndarray:
    """A seeded order of vectors that doesn't depend on where they are."""
    h = np.full(len(vecs), (seed * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(vecs.shape[1]):
            h = (h ^ vecs[:, j].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(33)
    return (h >> np.uint64(1)).astype(np.int64)


def sums_of(vecs: np.ndarray, weight: np.ndarray, codebook: np.ndarray, seed: int, hashes: np.ndarray | None = None) -> Sums:
    """Sums of vectors with their weights; hashes: their member_hash(), if it is known."""
    k, width = codebook.shape
    ix, d2 = nearest(vecs, codebook)
    n = np.bincount(ix, weights=weight, minlength=k).astype(np.int64)
    dist = np.bincount(ix, weights=weight * np.sqrt(d2), minlength=k)
    sq = np.bincount(ix, weights=weight * d2, minlength=k)
    total = np.zeros((k, width), dtype=np.int64)
    low, high = np.full((k, width), U16_MAX, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
    # Sorting small integers takes linear time.
    order = np.argsort(ix.astype(np.uint16) if k <= 1 << 16 else ix, kind="stable")
    used, at = np.unique(ix[order], return_index=True)
    pick, member = np.full(k, np.iinfo(np.int64).max), np.zeros((k, width), dtype=np.int64)
    if len(used):
        v = vecs[order]
        h = member_hash(v, seed) if hashes is None else hashes[order]
        total[used] = np.add.reduceat(v * weight[order].astype(np.int64)[:, None], at)
        low[used], high[used] = np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)
        pick[used] = np.minimum.reduceat(h, at)
        least = np.flatnonzero(h == pick[ix[order]])
        member[used] = v[least[np.searchsorted(least, at)]]
    return Sums(n, dist, sq, total, low, high, pick, member)


def merged(parts: list[Sums]) -> Sums:
    stack = [np.stack(x) for x in zip(*parts)]
    best = stack[6].argmin(axis=0)
    at = np.arange(stack[0].shape[1])
    return Sums(*(x.sum(axis=0) for x in stack[:4]), stack[4].min(axis=0), stack[5].max(axis=0), stack[6][best, at], stack[7][best, at])


#: Samples of a block of a distributed training set, tasks whose sums go to the driver as they are, and tasks that add up those of more.
BLOCK_SAMPLES, MOST_PARTS, ADDERS = 1 << 21, 32, 16
PARTS = "task int, sums binary"


def _packed(s: Sums) -> bytes:
    """Sums of the codewords that have vectors; components have 16 bits."""
    used = np.flatnonzero(s.n > 0)
    small = {4, 5, 7}
    return pickle.dumps((used, [x[used].astype(np.uint16) if i in small else x[used] for i, x in enumerate(s)]))


def _sums_of_parts(parts: list[bytes], k: int, width: int) -> Sums:
    out = Sums(np.zeros(k, dtype=np.int64), np.zeros(k), np.zeros(k), np.zeros((k, width), dtype=np.int64), np.full((k, width), U16_MAX, dtype=np.int64), np.zeros((k, width), dtype=np.int64), np.full(k, np.iinfo(np.int64).max), np.zeros((k, width), dtype=np.int64))
    for part in parts:
        used, s = pickle.loads(part)
        for a, b in zip(out[:4], s[:4]):
            a[used] += b
        out.low[used], out.high[used] = np.minimum(out.low[used], s[4]), np.maximum(out.high[used], s[5])
        less = s[6] < out.pick[used]
        out.pick[used[less]], out.member[used[less]] = s[6][less], s[7][less]
    return out


class TrainingSet:
    """Different training vectors with how often each stands, on the driver or distributed."""

    def __init__(self, vecs: DataFrame, width: int, seed: int = 1, local_samples: int = LOCAL_SAMPLES):
        self.width, self.seed = width, seed
        first = F.min(F.struct("z", "vec_ix")).alias("first") if {"z", "vec_ix"} <= set(vecs.columns) else F.lit(0).alias("first")
        counted = vecs.groupBy("vec").agg(F.count(F.lit(1)).alias("w"), first)
        self.rows = counted.persist()
        self.distinct = self.rows.count()
        self.local: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.blocks: DataFrame | None = None
        if self.distinct * width <= local_samples:
            t = self.rows.orderBy("first", "vec").select("vec", "w").toArrow()
            vecs = matrix(t.column("vec")).astype(np.int64)
            self.local = (vecs, t.column("w").to_numpy(), member_hash(vecs, seed))
        else:
            # Read once for every iteration, so they are kept; lost parts are made again from the input.
            self.blocks = self._blocks().persist()
            self.blocks.count()
            self.parts = self.blocks.rdd.getNumPartitions()
        self.rows.unpersist()

    def _blocks(self) -> DataFrame:
        """(vecs, w, h): many vectors of 16-bit components with their weights and hashes."""
        width, seed = self.width, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for b in batches:
                held.append((matrix(b.column("vec")).astype("<u2"), b.column("w").to_numpy()))
                if sum(v.size for v, _ in held) >= BLOCK_SAMPLES:
                    yield block(held)
                    held = []
            if sum(v.size for v, _ in held):
                yield block(held)

        def block(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            v, w = np.concatenate([v for v, _ in held if v.size]), np.concatenate([w for v, w in held if v.size])
            return pa.RecordBatch.from_pydict({n: pa.array([x.tobytes()], type=pa.binary()) for n, x in (("vecs", v.reshape(-1, width)), ("w", w.astype("<i8")), ("h", member_hash(v, seed).astype("<i8")))})

        # Few tasks of one block or more each, as every pass starts them all.
        tasks = max(self.rows.sparkSession.sparkContext.defaultParallelism, -(-self.distinct * width // BLOCK_SAMPLES))
        return self.rows.select("vec", "w").coalesce(tasks).mapInArrow(run, "vecs binary, w binary, h binary")

    def close(self) -> None:
        self.rows.unpersist()
        if self.blocks is not None:
            self.blocks.unpersist()

    def first_vectors(self, k: int) -> np.ndarray:
        """The different vectors in the order in which they first stand (at most k)."""
        if self.local:
            return self.local[0][:k]
        return matrix(self.rows.orderBy("first", "vec").limit(k).select("vec").toArrow().column("vec")).astype(np.int64)

    def sums(self, codebook: np.ndarray) -> Sums:
        if self.local:
            return sums_of(self.local[0], self.local[1], codebook, self.seed, self.local[2])
        k, width, seed = *codebook.shape, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for vecs, w, h in zip(*(b.column(n).to_pylist() for n in ("vecs", "w", "h"))):
                    part = sums_of(np.frombuffer(vecs, dtype="<u2").reshape(-1, width), np.frombuffer(w, dtype="<i8"), codebook, seed, np.frombuffer(h, dtype="<i8"))
                    total = part if total is None else merged([total, part])
            if total is not None:
                yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], type=pa.int32()), "sums": pa.array([_packed(total)], type=pa.binary())})

        def add(t: pa.Table) -> pa.Table:
            t = t.sort_by("task")
            return pa.table({"task": t.column("task").slice(0, 1), "sums": pa.array([_packed(_sums_of_parts(t.column("sums").to_pylist(), k, width))], type=pa.binary())})

        found = self.blocks.mapInArrow(run, PARTS)
        if self.parts > MOST_PARTS:
            found = found.groupBy(F.col("task") % ADDERS).applyInArrow(add, PARTS)
        return _sums_of_parts(found.toArrow().sort_by("task").column("sums").to_pylist(), k, width)


def refine(data: TrainingSet, codebook: np.ndarray, eps: float, log: list) -> tuple[np.ndarray, Sums]:
    """LBG: assign, move centroids, refill nearly empty codewords, until distortion hardly falls."""
    last_gain = last = float("inf")
    sums = None
    for iteration in range(1, MOST_ROUNDS + 1):
        sums = data.sums(codebook)
        codebook = np.where((sums.n > 0)[:, None], sums.centroids, codebook)
        codebook, sums = refill(data, codebook, sums)
        with np.errstate(divide="ignore", invalid="ignore"):
            distortion = float(np.mean(sums.dist / sums.n))
            gain = (last - distortion) / distortion if distortion else float("nan")
        log.append((len(codebook), iteration, distortion))
        if np.isnan(gain) or gain > last_gain or gain < eps:
            break
        last, last_gain = distortion, gain
    return codebook, sums


def refill(data: TrainingSet, codebook: np.ndarray, sums: Sums) -> tuple[np.ndarray, Sums]:
    """Codewords of fewer than two vectors move to a member of the largest parts, one part each."""
    for _ in range(MOST_ROUNDS):
        empty = np.flatnonzero(sums.n < 2)[::-1]
        zero = ~codebook.any(axis=1)
        donors = [int(i) for i in np.argsort(-sums.n, kind="stable") if sums.n[i] > 1 and not zero[i] and (sums.low[i] != sums.high[i]).any()]
        if not len(empty) or not donors:
            break
        moved = codebook.copy()
        for hole, donor in zip(empty, donors):
            moved[hole] = sums.member[donor]
        after = data.sums(moved)
        if (after.n < 2).sum() >= len(empty):
            break
        codebook, sums = np.where((after.n > 0)[:, None], after.centroids, moved), after
    return codebook, sums


def split(codebook: np.ndarray, sums: Sums, rng: np.random.Generator) -> np.ndarray:
    """Twice as many codewords: each plus and minus its perturbation, cut toward zero and to range.

    A zero codeword stays, with its perturbation as sibling; one that hardly spreads stays, with a
    random sibling; one without vectors is moved by a random perturbation.
    """
    out = []
    for i, c in enumerate(codebook):
        shift = sums.spread[i] if sums.n[i] else rng.integers(0, U16_MAX + 1, len(c)).astype(np.float64)
        if not c.any():
            out += [c, np.floor(shift)]
        elif (shift < 1).all():
            out += [c, rng.integers(0, U16_MAX + 1, len(c))]
        else:
            out += [np.trunc(c + shift), np.trunc(c - shift)]
    return np.clip(np.array(out), 0, U16_MAX).astype(np.int64)


def train(vecs: DataFrame, k: int, tile: Dims, seed: int = 1, found: Callable[[VectorCodebook], None] | None = None, local_samples: int = LOCAL_SAMPLES) -> Training:
    """A codebook of k vectors for vecs (vec, and z and vec_ix for the order).

    Fewer different vectors than k: these in order, then zero vectors, without error. found: gets
    the codebook after every doubling and at the end, which then uses the finer threshold.
    """
    data = TrainingSet(vecs, tile.count, seed, local_samples)
    try:
        return train_on(data, k, tile, seed, found)
    finally:
        data.close()


def train_on(data: TrainingSet, k: int, tile: Dims, seed: int = 1, found: Callable[[VectorCodebook], None] | None = None) -> Training:
    """train() on a training set."""
    log: list[tuple[int, int, float]] = []
    if not data.distinct:
        raise ValueError("no vectors to train on")
    if data.distinct < k:
        book = np.zeros((k, tile.count), dtype=np.int64)
        first = data.first_vectors(k)
        book[: len(first)] = first
        return _finished(data, book, tile, log)
    rng = np.random.default_rng(seed)
    book = data.sums(np.zeros((1, tile.count), dtype=np.int64)).centroids
    sums = data.sums(book)
    while len(book) < k:
        book, sums = refine(data, split(book, sums, rng), FINE_EPS if found else SPLIT_EPS, log)
        if found:
            found(_finished(data, book, tile, log).codebook)
    book, _ = refine(data, book, FINE_EPS, log)
    out = _finished(data, book, tile, log)
    if found:
        found(out.codebook)
    return out


def train_sizes(data: TrainingSet, sizes: list[int], tile: Dims, seed: int = 1) -> dict[int, VectorCodebook]:
    """What train_on() gives for each of several sizes; the splits on the way to the largest are made once."""
    out = {k: train_on(data, k, tile, seed).codebook for k in sizes if k < 2 or data.distinct < k}
    rest = [k for k in sizes if k not in out]
    if rest:
        rng = np.random.default_rng(seed)
        book = data.sums(np.zeros((1, tile.count), dtype=np.int64)).centroids
        sums = data.sums(book)
        while len(book) < max(rest):
            book, sums = refine(data, split(book, sums, rng), SPLIT_EPS, [])
            if len(book) in rest:
                out[len(book)] = _finished(data, refine(data, book, FINE_EPS, [])[0], tile, []).codebook
    return out


def _finished(data: TrainingSet, book: np.ndarray, tile: Dims, log: list) -> Training:
    sums = data.sums(book)
    mse = float(sums.sq.sum() / sums.n.sum())
    return Training(VectorCodebook(book, sums.n, tile), mse, decibels(mse), list(log))


def train_all_sizes(vecs: DataFrame, tile: Dims, most: int = 256, seed: int = 1) -> list[VectorCodebook]:
    """Codebooks of 2, 4 .. `most` vectors from one run; the last is the final one."""
    out: dict[int, VectorCodebook] = {}
    train(vecs, most, tile, seed, found=lambda cb: out.update({len(cb.vectors): cb}))
    return [out[k] for k in sorted(out)]


def has_more_than(vecs: DataFrame, k: int) -> bool:
    """Whether there are more than k different vectors. A task stops reading once it has found so many,
    and passes on k + 1 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: np.ndarray | None = None
        for b in batches:
            here = np.unique(matrix(b.column("vec")), axis=0)
            seen = here if seen is None or not len(seen) else np.unique(np.concatenate((seen, here)), axis=0)
            if len(seen) > k:
                break
        if seen is not None and len(seen):
            yield pa.RecordBatch.from_arrays([list_column(seen[: k + 1])], names=["vec"])

    return vecs.select("vec").mapInArrow(run, "vec array<int>").distinct().limit(k + 1).count() > k


def assign(vecs: DataFrame, codebook: VectorCodebook) -> DataFrame:
    """vecs with ix and d2 of the nearest codeword, by matrix products over Arrow batches."""
    names = [c for c in vecs.columns if c not in ("ix", "d2")]
    schema = ", ".join(f"`{c}` {vecs.schema[c].dataType.simpleString()}" for c in names) + ", ix int, d2 double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ix, d2 = nearest(matrix(b.column("vec")), codebook.vectors)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ix.astype(np.int32)), pa.array(d2)], names=[*names, "ix", "d2"])

    return vecs.select(*names).mapInArrow(run, schema)


def assign_by_join(vecs: DataFrame, codebook: DataFrame, metric: Metric = Metric.EUCLIDEAN) -> DataFrame:
    """The same as one relational plan for any metric: the codebook (at most 256 rows) goes along as
    an array, and the least (distance, ix) is taken row by row."""
    book = codebook.agg(F.array_sort(F.collect_list(F.struct("ix", F.col("vec").alias("cv")))).alias("book"))
    best = F.array_min(F.transform("book", lambda c: F.struct(distance(F.col("vec"), c["cv"], metric).alias("d"), c["ix"].alias("ix"))))
    joined = vecs.withColumn("_one", F.lit(1)).join(F.broadcast(book.withColumn("_one", F.lit(1))), "_one")
    return joined.withColumn("_best", best).select(*vecs.columns, F.col("_best.ix").alias("ix"), F.col("_best.d").alias("dist"))


def decode(indices: DataFrame, codebook: DataFrame, by_plane: bool = False) -> DataFrame:
    """Rows (z, vec_ix, ix) with the codeword's vector; by_plane: each plane has its codebook."""
    if by_plane:
        return indices.join(codebook.select("z", "ix", "vec"), ["z", "ix"])
    return indices.join(F.broadcast(codebook.select("ix", "vec")), "ix")


def entry_stats(assigned: DataFrame, width: int) -> DataFrame:
    """(ix, n, dist_sum, avg_dist, centroid, perturbation) of assigned vectors, one aggregate."""
    dims = range(width)
    sums = [F.sum(F.col("vec")[i].cast("long")).alias(f"s{i}") for i in dims]
    ends = [f(F.col("vec")[i]).alias(f"{n}{i}") for i in dims for n, f in (("l", F.min), ("h", F.max))]
    got = assigned.groupBy("ix").agg(F.count(F.lit(1)).alias("n"), F.sum(F.sqrt("d2")).alias("dist_sum"), *sums, *ends)
    centroid = F.array(*(F.floor(F.col(f"s{i}") / F.col("n") + 0.5).cast("int") for i in dims))
    shift = F.array(*((F.col(f"h{i}") - F.col(f"l{i}")) / SPREAD_SHARE for i in dims))
    return got.select("ix", "n", "dist_sum", (F.col("dist_sum") / F.col("n")).alias("avg_dist"), centroid.alias("centroid"), shift.alias("perturbation"))


def frequencies(assigned: DataFrame, k: int) -> DataFrame:
    """(ix, n) for all k codewords, zeros too."""
    spark = assigned.sparkSession
    n = assigned.groupBy("ix").agg(F.count(F.lit(1)).alias("n"))
    return spark.range(k).select(F.col("id").cast("int").alias("ix")).join(n, "ix", "left").select("ix", F.coalesce("n", F.lit(0)).alias("n"))


def mean_distortion(stats: DataFrame) -> DataFrame:
    """The unweighted mean of the codewords' average distances."""
    return stats.agg(F.avg("avg_dist").alias("distortion"))


def perturbed(vec: Column, shift: Column, plus: bool) -> Column:
    """A split child: cut toward zero."""
    return F.zip_with(vec, shift, lambda v, s: (v + s if plus else v - s).cast("int"))
