"""Near-duplicate documents by a MinHash LSH forest.

Equal shingle sets are collapsed first. Every remaining set has a MinHash signature, cut into
several trees: a tree is the order of all sets by its part of the signature, range-partitioned and
sorted, so crowded regions are split like any other. A region is what shares the first values of a
tree: all its sets are compared with each other, block by block however many they are, but for
those that are in one group already. Regions that partitions cut are compared by pairs of
partitions as well. A short sketch drops most false candidates. Candidates only group sets; within
each group the links are confirmed on full shingle sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantavol.llm import _text as t
from quantavol.llm._common import Stage, need, partitions, tidy
from quantavol.llm.graph import components


class Forest(NamedTuple):
    """trees of `depth` signature values; candidates share at least `least` values of a tree.

    near: following neighbours that are compared first; region: sets of a region that are compared
    at once; sketch: signature bytes that travel with a set; slack: how far the sketch's estimate
    may lie below the wanted similarity; chunk: sets whose links are confirmed at once.
    """

    trees: int = 16
    depth: int = 6
    least: int = 4
    near: int = 8
    region: int = 1024
    sketch: int = 64
    slack: float = 0.22
    chunk: int = 128


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and offsets of the texts.

    A-Z are lowered. A text of fewer words has its whole sequence as one shingle; none without words.
    """
    w = t.split_words(column, lower=True)
    n = len(w.doc_at) - 1
    if not len(w.start):
        return np.zeros(0, dtype=np.uint64), np.zeros(n + 1, dtype=np.int64)
    h = t.word_hashes(w)
    place = np.flatnonzero(t.whole_gram_mask(w.first, width))
    grams = t.gram_hashes(h, width)[place] if len(place) else np.zeros(0, dtype=np.uint64)
    doc = np.searchsorted(w.first, place, side="right") - 1
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))
    if len(short):
        with np.errstate(over="ignore"):
            whole = np.zeros(len(short), dtype=np.uint64)
            for k in range(width - 1):
                more = w.counts[short] > k
                at = np.minimum(w.first[short] + k, len(h) - 1)
                whole = np.where(more, t.mix(whole * np.uint64(3) + h[at]), whole)
        grams, doc = np.concatenate((grams, whole)), np.concatenate((doc, short))
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])))
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(n + 1))


def min_hashes(grams: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """(texts, n) MinHash values of 32 bits; texts without shingles have zeros.

    The minima of large sets are small numbers, so all their bits are mixed before 32 are kept.
    """
    out = np.zeros((len(at) - 1, n), dtype=np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        starts = at[:-1][full]
        with np.errstate(over="ignore"):
            for i, (a, b) in enumerate(zip(t.seeds(n, 21) | np.uint64(1), t.seeds(n, 22))):
                out[full, i] = t.mix(np.minimum.reduceat(grams * a + b, starts)) >> np.uint64(32)
    return out


def set_hashes(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: equal sets have equal sums, others differ but for chance."""
    out = np.zeros((2, len(at) - 1), dtype=np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        with np.errstate(over="ignore"):
            for k in range(2):
                out[k, full] = np.add.reduceat(t.mix(grams + t.seeds(1, 31 + k)[0]), at[:-1][full])
    return out[0], out[1]


def signatures(docs: DataFrame, forest: Forest, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (which tell sets apart) and sig (null without shingles)."""
    n = forest.trees * forest.depth
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in t.slices(batch.column("text")):
                grams, at = shingle_sets(batch.column("text").slice(i, j - i), width)
                values = min_hashes(grams, at, n).astype(">u4")
                s1, s2 = set_hashes(grams, at)
                count = np.diff(at)
                sig = [v.tobytes() if c else None for v, c in zip(values, count.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(count), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(sig, type=pa.binary())],
                    names=["doc_id", "n_shingles", "s1", "s2", "sig"],
                )
            tidy()

    return need(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, s1 long, s2 long, sig binary")


class _Sets:
    """Union by smallest member of row numbers."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        while (self.up != self.up[self.up]).any():
            self.up = self.up[self.up]
        return self.up


class _Rows(NamedTuple):
    """Sorted rows of trees: tree, prefix (rows, depth), sketch (rows, bytes), size and node."""

    tree: np.ndarray
    prefix: np.ndarray
    sketch: np.ndarray
    size: np.ndarray
    node: np.ndarray

    def close(self, a: np.ndarray, b: np.ndarray, percent: int, slack: float) -> np.ndarray:
        """Whether sizes allow the similarity and sketches don't speak against it."""
        low, high = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        ok = 100 * low >= percent * high
        ok[ok] = (self.sketch[a[ok]] == self.sketch[b[ok]]).mean(axis=1) >= percent / 100 - slack
        return ok


def _rows(table: pa.Table, forest: Forest) -> _Rows:
    def binary(name: str, width: int, dtype: str) -> np.ndarray:
        data, _ = t.flat_bytes(table.column(name).combine_chunks() if table.num_rows else pa.array([], type=pa.binary()))
        return np.frombuffer(data.tobytes(), dtype=dtype).reshape(-1, width)

    return _Rows(table.column("tree").to_numpy(), binary("prefix", forest.depth, ">u2"), binary("sketch", forest.sketch, "u1"), table.column("n").to_numpy(), table.column("node").to_numpy())


def candidate_sets(r: _Rows, forest: Forest, percent: int, side: np.ndarray | None = None, known: np.ndarray | None = None) -> _Sets:
    """Groups of rows that are candidates: rows of one region whose sizes and sketches allow it.

    side: only rows of different sides are compared. known: rows of equal numbers are one group.
    """
    m = len(r.node)
    sets = _Sets(m)
    if m < 2:
        return sets
    if known is not None:
        _, first, which = np.unique(known, return_index=True, return_inverse=True)
        sets.up = first[which]
    # How many leading values each row shares with the next one (of the same tree).
    same = (r.prefix[1:] == r.prefix[:-1]) & (r.tree[1:] == r.tree[:-1])[:, None]
    shared = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    lcp = shared.copy()
    for step in range(1, min(forest.near, m - 1) + 1):
        if step > 1:
            lcp = np.minimum(lcp[:-1], shared[step - 1 :])
        a = np.flatnonzero(lcp >= forest.least)
        hit = r.close(a, a + step, percent, forest.slack)
        sets.join(a[hit], a[hit] + step)

    def roots(lo: int, hi: int) -> np.ndarray:
        at = sets.up[lo:hi]
        while (at != sets.up[at]).any():
            at = sets.up[at]
        return at

    def region(lo: int, hi: int) -> None:
        """Compares rows lo .. hi that aren't in one group yet, a block of rows with a block of rows."""
        done = np.zeros(hi - lo, dtype=bool)
        while True:
            # Rows outside the largest group against all rows; pairs within it need no look.
            now = roots(lo, hi)
            names, counts = np.unique(now, return_counts=True)
            some = np.flatnonzero((now != names[counts.argmax()]) & ~done)[:64]
            if not len(some):
                return
            rest = np.flatnonzero(~done)
            for x in range(0, len(rest), forest.region):
                block = rest[x : x + forest.region]
                a, b = np.repeat(some, len(block)), np.tile(block, len(some))
                other = now[a] != now[b]
                if side is not None:
                    other &= side[a + lo] != side[b + lo]
                a, b = a[other], b[other]
                hit = r.close(a + lo, b + lo, percent, forest.slack)
                if hit.any():
                    met = np.unique(np.column_stack((now[a[hit]], now[b[hit]])), axis=0)
                    sets.join(met[:, 0], met[:, 1])
                    now = roots(lo, hi)
            done[some] = True

    cut = np.flatnonzero(shared < forest.least) + 1
    begins, ends = np.concatenate(([0], cut)), np.concatenate((cut, [m]))
    far = ends - begins > forest.near + 1
    for lo, hi in zip(begins[far].tolist(), ends[far].tolist()):
        region(lo, hi)
    return sets


ROW_SCHEMA = "tree int, prefix binary, sketch binary, n long, node long"


def forest_links(stage: Stage, sets: DataFrame, forest: Forest, percent: int) -> DataFrame:
    """Candidate links (a, b) between sets (node, n, sig): stars, not all pairs of a group."""
    part = lambda i: F.concat(*(F.substring("sig", 4 * (i * forest.depth + k) + 1, 2) for k in range(forest.depth)))
    sketch = F.concat(*(F.substring("sig", 4 * k + 4, 1) for k in range(forest.sketch)))
    trees = F.array(*(F.struct(F.lit(i).alias("tree"), part(i).alias("prefix")) for i in range(forest.trees)))
    rows = sets.select(F.explode(trees).alias("x"), sketch.alias("sketch"), F.col("n_shingles").alias("n"), "node").select("x.*", "sketch", "n", "node")
    # A partition is compared as a whole, so there are more of them where there are more sets.
    n = max(partitions(stage.spark), sets.count() * forest.trees // 100_000)
    ordered = rows.repartitionByRange(n, "tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        r = _rows(table, forest)
        roots = candidate_sets(r, forest, percent).roots()
        a, b = _stars(roots, r.node)
        none = pa.nulls(len(a))
        blank = [none.cast(kind) for kind in (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())]
        names = ["a", "b", "part", "root", "tree", "prefix", "sketch", "n", "node"]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *blank], names=names)
        # The regions at both ends may go on in other partitions: their rows and groups are kept.
        key = np.column_stack((r.tree, r.prefix[:, : forest.least]))
        edge = (key == key[0]).all(axis=1) | (key == key[-1]).all(axis=1)
        k, ends = int(edge.sum()), table.filter(pa.array(edge))
        empty = pa.nulls(k).cast(pa.int64())
        part_ = np.full(k, TaskContext.get().partitionId(), dtype=np.int32)
        yield from pa.table([empty, empty, pa.array(part_), pa.array(r.node[roots[edge]]), *(ends.column(c) for c in names[4:])], names=names).to_batches()

    found = stage.table(ordered.mapInArrow(run, f"a long, b long, part int, root long, {ROW_SCHEMA}"), "neighbours")

    def over_seam(table: pa.Table) -> pa.Table:
        table = table.sort_by([("prefix", "ascending"), ("node", "ascending")])
        r = _rows(table, forest)
        a, b = _stars(candidate_sets(r, forest, percent, table.column("part").to_numpy(), table.column("root").to_numpy()).roots(), r.node)
        return pa.table({"a": a, "b": b})

    # A region in several partitions: each pair of them is a piece of work.
    ends = found.filter(F.col("part").isNotNull()).drop("a", "b").withColumn("key", F.substring("prefix", 1, 2 * forest.least))
    held = ends.select("tree", "key", "part").distinct()
    other = held.select(F.col("tree").alias("t2"), F.col("key").alias("k2"), F.col("part").alias("high"))
    pairs = held.join(other, (F.col("tree") == F.col("t2")) & (F.col("key") == F.col("k2")) & (F.col("part") < F.col("high")))
    pairs = pairs.select(F.col("tree").alias("t"), F.col("key").alias("k"), F.col("part").alias("low"), "high").withColumn("p", F.explode(F.array("low", "high")))
    pieces = ends.join(pairs, (F.col("tree") == F.col("t")) & (F.col("key") == F.col("k")) & (F.col("part") == F.col("p")))
    seams = pieces.select("low", "high", "key", "part", "root", *(c.split()[0] for c in ROW_SCHEMA.split(", "))).groupBy("tree", "key", "low", "high").applyInArrow(over_seam, "a long, b long")
    return found.filter(F.col("part").isNull()).select("a", "b").unionAll(seams)


def _stars(roots: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group its smallest node with every other one."""
    order = np.lexsort((node, roots))
    g, node = roots[order], node[order]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, dtype=np.int64)
    low = np.repeat(node[first], np.diff(np.concatenate((first, [len(g)]))))
    keep = low != node
    pairs = np.unique(np.column_stack((low[keep], node[keep])), axis=0) if keep.any() else np.zeros((0, 2), dtype=np.int64)
    return pairs[:, 0], pairs[:, 1]


def confirmed(grams: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets with 100 * intersection >= percent * union, by exact counts.

    side: only pairs of different sides. Intersections come from products of 0/1 matrices over the
    shingles that two sets or more have, some thousand shingles at a time.
    """
    m = len(grams)
    size = np.array([len(g) for g in grams], dtype=np.int64)
    owner, every = np.repeat(np.arange(m), size), np.concatenate(grams) if m else np.zeros(0, dtype=np.uint64)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate(([True], every[1:] != every[:-1])) if len(every) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    count = np.diff(np.concatenate((at, [len(every)])))
    shared = count > 1
    rows = t.ragged(at[shared], count[shared])
    which, who = np.repeat(np.arange(int(shared.sum())), count[shared]), owner[rows]
    both = np.zeros((m, m), dtype=np.float64)
    step = max(256, (1 << 22) // max(m, 1))
    for lo in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(which, (lo, lo + step))
        block = np.zeros((min(step, int(shared.sum()) - lo), m), dtype=np.float32)
        block[which[a:b] - lo, who[a:b]] = 1
        both += block.T @ block
    both = np.rint(both).astype(np.int64)
    link = np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1)
    if side is not None:
        link &= side[:, None] != side[None, :]
    return np.nonzero(link)


def confirm(stage: Stage, groups: DataFrame, texts: DataFrame, forest: Forest, percent: int, width: int, name: str) -> DataFrame:
    """Links (a, b) that hold within each piece of work.

    groups: (node, work, side): sets of one `work` are compared, those of different sides only
    where side isn't null. texts: (node, text). Many small pieces share a task's call.
    """
    spark = stage.spark
    bins = max(4 * partitions(spark), groups.count() // 1000)
    rows = groups.withColumn("bin", F.pmod(F.xxhash64("work"), F.lit(bins)).cast("int")).join(texts, "node").select("bin", "work", "node", "side", "text")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("work", "ascending"), ("node", "ascending")])
        work, node = table.column("work").to_numpy(), table.column("node").to_numpy()
        side = table.column("side").fill_null(-1).to_numpy()
        texts_ = table.column("text").combine_chunks() if table.num_rows else pa.array([], type=pa.string())
        grams: list[np.ndarray] = []
        for i, j in t.slices(texts_):
            g, at = shingle_sets(texts_.slice(i, j - i), width)
            grams += [g[x:y] for x, y in zip(at[:-1], at[1:])]
        out_a, out_b = [], []
        cut = np.flatnonzero(np.concatenate(([True], work[1:] != work[:-1]))) if len(work) else []
        for lo, hi in zip(cut, [*cut[1:], len(work)]):
            a, b = confirmed(grams[lo:hi], percent, side[lo:hi] if side[lo] >= 0 else None)
            sets = _Sets(hi - lo)
            sets.join(a, b)
            roots = sets.roots()
            other = roots != np.arange(hi - lo)
            out_a.append(node[lo:hi][roots[other]])
            out_b.append(node[lo:hi][other])
        tidy()
        return pa.table({"a": np.concatenate(out_a) if out_a else np.zeros(0, dtype=np.int64), "b": np.concatenate(out_b) if out_b else np.zeros(0, dtype=np.int64)})

    return stage.table(rows.groupBy("bin").applyInArrow(run, "a long, b long"), f"{name}-links", "snappy")


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 80, width: int = 5, forest: Forest = Forest()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two documents are linked if their sets of distinct lower-cased shingles of `width` words have
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable by links.
    Null, empty and wordless texts have no shingle and no link. doc_id is an integer; rows that
    repeat a doc_id are one node, whatever their texts; a null doc_id takes no part and is kept.
    Candidate search is probabilistic: at the defaults a pair just at 80 % is found with
    probability above 0.9997 in one of the trees, more similar ones more surely.
    """
    stage = Stage(spark, "neardup")
    sig = stage.table(signatures(docs, forest, width), "signatures")
    some = sig.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    key = ("s1", "s2", "n_shingles")
    sets = stage.table(some.groupBy(*key).agg(F.min("doc_id").cast("long").alias("node"), F.first("sig").alias("sig")), "sets")
    links = stage.table(forest_links(stage, sets, forest, percent), "candidates", "snappy")
    groups = components(stage, links, "groups")

    # Pieces of work: a group, or a chunk of a large one in the order of nodes.
    size = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    sized = _of_root(groups.select("node", "root"), size.filter(F.col("size") > forest.chunk), "left").withColumn("size", F.coalesce("size", F.lit(1)))
    chunks = F.ceil(F.col("size") / forest.chunk).cast("int")
    cut = stage.table(sized.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int")), "chunks", "snappy")
    ids = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    texts = stage.table(ids.join(cut.select("node"), "node"), "texts")
    no_side = F.lit(None).cast("int").alias("side")
    held = [confirm(stage, cut.select("node", F.xxhash64("root", "chunk").alias("work"), no_side), texts, forest, percent, width, "within")]

    large = cut.filter("chunks > 1")
    if not large.isEmpty():
        # Large groups: a few delegates of each confirmed part first, again while that joins parts; what
        # they leave apart is then compared chunk by chunk, so that no link across chunks is lost.
        before = None
        for k in itertools.count():
            parts = components(stage, _union(held), f"so-far-{k}")
            now = large.join(parts.select("node", F.col("root").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))
            apart = now.groupBy("root").agg(F.countDistinct("part").alias("parts")).filter("parts > 1")
            left = apart.agg(F.sum("parts").alias("n")).first()["n"]
            if not left:
                break
            now = stage.table(_of_root(now, apart.select("root"), "inner"), f"open-{k}", "snappy")
            if before is None or 5 * left <= 4 * before:
                before = left
                w = Window.partitionBy("root", "part").orderBy("node")
                few = now.withColumn("r", F.row_number().over(w)).filter("r <= 2")
                pieces = few.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / forest.chunk).cast("int").alias("pieces"))
                few = few.join(pieces, "root").withColumn("piece", F.pmod(F.xxhash64("part", F.lit(k)), "pieces").cast("int"))
                work = few.select("node", F.xxhash64("root", "piece").alias("work"), no_side)
                held.append(confirm(stage, work, texts, forest, percent, width, f"delegates-{k}"))
                continue
            # Each pair of chunks is a piece of work. A part of many sets has chunks of its own, so
            # that pairs of chunks of one part, which is linked already, are left out; what is left
            # of a large part and few others grows with the part's size, not its square. Small parts
            # share chunks, which are compared within as well.
            m = now.groupBy(F.col("root").alias("r3"), F.col("part").alias("p3")).agg(F.count(F.lit(1)).alias("m"))
            bins = m.filter(F.col("m") < forest.chunk).groupBy(F.col("r3").alias("r4")).agg(F.ceil(F.sum("m") / forest.chunk).cast("long").alias("bins"))
            now = now.drop("chunk", "chunks").join(m, (F.col("root") == F.col("r3")) & (F.col("part") == F.col("p3"))).join(bins, F.col("root") == F.col("r4"), "left")
            own = F.xxhash64(F.lit("part"), "part", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / forest.chunk).cast("long")))
            shared = F.xxhash64(F.lit("bin"), F.pmod(F.xxhash64("part"), F.coalesce("bins", F.lit(1).cast("long"))))
            now = stage.table(now.withColumn("chunk", F.when(F.col("m") >= forest.chunk, own).otherwise(shared)).select("node", "root", "part", "chunk"), "apart", "snappy")
            chunk = now.groupBy("root", "chunk").agg(F.min("part").alias("low"), F.max("part").alias("high"))
            other = chunk.select(F.col("root").alias("r2"), F.col("chunk").alias("c2"), F.col("low").alias("l2"), F.col("high").alias("h2"))
            pairs = chunk.join(other, (F.col("root") == F.col("r2")) & (F.col("chunk") < F.col("c2")))
            pairs = pairs.filter(~((F.col("low") == F.col("high")) & (F.col("l2") == F.col("h2")) & (F.col("low") == F.col("l2"))))
            ends = pairs.select("root", "chunk", "c2", F.explode(F.array(F.struct(F.col("chunk").alias("c"), F.lit(0).alias("side")), F.struct(F.col("c2").alias("c"), F.lit(1).alias("side")))).alias("x"))
            ends = ends.select("root", F.xxhash64("root", "chunk", "c2").alias("work"), "x.c", "x.side")
            work = now.select("node", F.col("root").alias("r"), F.col("chunk").alias("k")).join(ends, (F.col("r") == F.col("root")) & (F.col("k") == F.col("c"))).select("node", "work", "side")
            mixed = chunk.filter("low <> high").select(F.col("root").alias("r5"), F.col("chunk").alias("c5"))
            within = now.join(mixed, (F.col("root") == F.col("r5")) & (F.col("chunk") == F.col("c5"))).select("node", F.xxhash64("root", "chunk").alias("work"), no_side)
            held.append(confirm(stage, work.unionAll(within), texts, forest, percent, width, "across"))
            break
    final = components(stage, _union(held), "final")
    # What the result doesn't read goes; of signatures and sets it needs the keys alone.
    keys = stage.table(sig.drop("sig"), "keys")
    sets = stage.table(sets.drop("sig"), "nodes")
    stage.drop("signatures", "sets", "neighbours", "candidates", "texts", "chunks")

    nodes = sets.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(key)), "node").join(final.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left")
    nodes = nodes.select("k0", "k1", "k2", F.coalesce("root", "node").alias("component"))
    out = keys.join(nodes, (F.col("s1") == F.col("k0")) & (F.col("s2") == F.col("k1")) & (F.col("n_shingles") == F.col("k2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", F.col("doc_id").cast("long")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


#: Shares that the rows of a root are dealt over in joins with facts of roots.
SALTS = 64


def _of_root(rows: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """rows (node, root, ...) with facts of some roots, the large or open ones; a root may have a third of all rows."""
    names = [F.col(c) for c in (*rows.columns, *(c for c in facts.columns if c != "root"))]
    many = facts.withColumnRenamed("root", "of").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("share", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return dealt.join(many, (F.col("root") == F.col("of")) & (F.col("share") == F.col("salt")), how).select(*names)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
