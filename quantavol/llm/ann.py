"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a long string of sign bits of random projections; a tree is the
sorted array of those strings. A query first descends every tree to the longest prefix that it
shares with enough rows. Its k-th best score then tells to which depth all trees must ascend
together so that a row as near as that one is missed with a small probability: two strings agree
in a bit with probability 1 - angle / pi. (LSH forest: Bawa, Condie and Ganesan, 2005.) Largest
inner product becomes smallest angle by one more component that lifts all vectors to the same
norm (Neyshabur and Srebro, 2015).

The index holds strings and places, not vectors: a tree's array is cut into parts by its leading
bits, and a query meets only the parts whose leading bits it shares, unless it ascends above them.
Vectors are stored once, in blocks. A part tells each block which of its rows are candidates of
which queries, a range of the array once for all queries that share it; the block scores these
rows and no others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantavol.llm._blocks import spread, squeeze
from quantavol.llm._common import Stage, need, tidy
from quantavol.llm._text import ragged, seeds

BITS = 32


class Forest(NamedTuple):
    """trees: sorted arrays; descent: rows of a tree at which the first descent stops (k + 1 at least);
    miss: bound on the probability that the k-th neighbour is missed; part_rows: about so many rows
    in a part; block_bytes: of vectors in a block, as doubles; crowd: rows of a part beyond which it is split."""

    trees: int = 64
    descent: int = 16
    miss: float = 0.1
    part_rows: int = 4096
    block_bytes: int = 8 << 20
    crowd: int = 1 << 20


def planes(trees: int, dims: int) -> np.ndarray:
    """(dims, trees * BITS) normal variates, the same on every machine (Box-Muller over fixed seeds)."""
    n = trees * BITS * dims
    u = (seeds(2 * n, 11) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return (np.sqrt(-2 * np.log(np.maximum(u[:n], 1e-300))) * np.cos(2 * np.pi * u[n:])).reshape(dims, trees * BITS)


def bit_strings(x: np.ndarray, trees: int) -> np.ndarray:
    """(rows, trees) strings of BITS bits as integers, the first bit highest."""
    bits = (x @ planes(trees, x.shape[1]) > 0).reshape(len(x), trees, BITS)
    return (bits.astype(np.int64) << np.arange(BITS - 1, -1, -1, dtype=np.int64)).sum(axis=2)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as doubles, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(n) and (n == dims).all():
        return flat.reshape(len(n), dims)
    out = np.zeros((len(n), dims))
    at = np.concatenate(([0], np.cumsum(n)))
    for i in range(len(n)):
        out[i, : n[i]] = flat[at[i] : at[i + 1]]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: with an id, not null, finite, not all zero."""
    v, big = F.col("embedding"), F.lit(float("inf"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(v, lambda x: x != 0)
    return need(vectors, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(ok, F.lit(False)))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """Equal vectors once, with their k + 1 smallest ids: more can't be among the k nearest of any
    query, as equal scores go to smaller ids. A task passes on k + 1 ids of a vector at most."""
    w = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("_r", F.dense_rank().over(w)).filter(F.col("_r") <= k + 1)
    return few.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))


def write_blocks(stage: Stage, rows: DataFrame, n_blocks: int) -> DataFrame:
    """Rows (block, pos, embedding, ids): vectors dealt over blocks by hash, numbered from 0 in each."""

    def number(key: tuple, table: pa.Table) -> pa.Table:
        return table.append_column("pos", pa.array(np.arange(table.num_rows, dtype=np.int32))).select(["block", "pos", "embedding", "ids"])

    kind, ids = (rows.schema[c].dataType.simpleString() for c in ("embedding", "ids"))
    dealt = rows.select(F.pmod(F.xxhash64("embedding"), F.lit(n_blocks)).alias("block"), "embedding", "ids")
    return stage.table(dealt.groupBy("block").applyInArrow(number, f"block long, pos int, embedding {kind}, ids {ids}"), "base", "snappy")


def _strings(x: np.ndarray, largest: float, trees: int, query: bool) -> np.ndarray:
    """Bit strings of rows lifted to one norm; queries have no lift."""
    norm = np.sqrt((x * x).sum(axis=1))
    scale = norm if query else np.full(len(x), largest)
    lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, 1 - (norm / largest) ** 2))
    return bit_strings(np.column_stack((x / scale[:, None], lift)), trees)


PART = "tree int, part long, salt int"


def plant(stage: Stage, base: DataFrame, dims: int, largest: float, forest: Forest, lead: int) -> tuple[DataFrame, DataFrame]:
    """The index, a row (tree, part, salt, body) for each part, and the salts of each (tree, part).

    A body has the part's strings in ascending order with the blocks and places of their vectors.
    Parts of more rows than `crowd` are dealt over salts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                h = _strings(_matrix(b.column("embedding"), dims), largest, forest.trees, False)
                blocks, which = np.unique(b.column("block").to_numpy(), return_inverse=True)
                pos = b.column("pos").to_numpy()
                out: list[tuple[int, int, int, bytes]] = []
                for tree in range(forest.trees):
                    order = np.argsort(h[:, tree], kind="stable")
                    part = h[order, tree] >> (BITS - lead)
                    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
                    for i, j in zip(cut[:-1], cut[1:]):
                        rows = order[i:j]
                        out.append((tree, int(part[i]), int(j - i), squeeze(h[rows, tree].astype("<u4"), blocks.astype("<i8"), which[rows].astype("<u4"), pos[rows].astype("<u4"))))
                trees, parts, n, body = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(trees, type=pa.int32()), pa.array(parts, type=pa.int64()), pa.array(n, type=pa.int64()), pa.array(body, type=pa.binary())], names=["tree", "part", "n", "body"])
        tidy()

    pieces = stage.table(base.select("block", "pos", "embedding").mapInArrow(run, "tree int, part long, n long, body binary"), "pieces", "snappy")
    salts = F.ceil(F.sum("n") / forest.crowd).cast("int").alias("salts")
    crowd = stage.table(pieces.groupBy("tree", "part").agg(salts), "crowd", "snappy")

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        got = [spread(x, "<u4", "<i8", "<u4", "<u4") for x in table.column("body").to_pylist()]
        b, block = np.concatenate([g[0] for g in got]), np.concatenate([g[1][g[2]] for g in got])
        pos = np.concatenate([g[3] for g in got])
        order = np.lexsort((pos, block, b))
        blocks, which = np.unique(block, return_inverse=True)
        body = squeeze(b[order], blocks.astype("<i8"), which[order].astype("<u4"), pos[order])
        return pa.table({"tree": pa.array([key[0].as_py()], type=pa.int32()), "part": pa.array([key[1].as_py()], type=pa.int64()), "salt": pa.array([key[2].as_py()], type=pa.int32()), "body": pa.array([body], type=pa.binary())})

    salted = pieces.join(crowd, ["tree", "part"]).withColumn("salt", F.pmod(F.xxhash64("body"), "salts").cast("int"))
    index = stage.table(salted.select("tree", "part", "salt", "body").groupBy("tree", "part", "salt").applyInArrow(merge, f"{PART}, body binary"), "index", "snappy")
    stage.drop("pieces")
    return index, crowd


def query_strings(asked: DataFrame, dims: int, largest: float, forest: Forest, lead: int) -> DataFrame:
    """A row (tree, part, b, q) for every query and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                h = _strings(_matrix(b.column("embedding"), dims), largest, forest.trees, True)
                for tree in range(forest.trees):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), tree, dtype=np.int32)), pa.array(h[:, tree] >> (BITS - lead)), pa.array(h[:, tree]), b.column("q")], names=["tree", "part", "b", "q"])

    return asked.select("q", "embedding").mapInArrow(run, "tree int, part long, b long, q long")


def _ranges(bits: np.ndarray, b: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a sorted array shares the first `level` bits with each string."""
    rest = (BITS - level).astype(np.int64)
    low = (b >> rest) << rest
    return np.searchsorted(bits, low), np.searchsorted(bits, low + (np.int64(1) << rest))


def candidates_of_part(body: bytes, b: np.ndarray, q: np.ndarray, level: np.ndarray, descent: int, lead: int) -> list[tuple[int, bytes]]:
    """(block, message): the rows of each block that share a query's prefix in this part.

    A query's level says how many bits; below 0, the most that `descent` rows share. A message has
    ranges: rows of each, the rows, queries of each, the queries.
    """
    bits, blocks, which, pos = spread(body, "<u4", "<i8", "<u4", "<u4")
    bits, level = bits.astype(np.int64), level.astype(np.int64)
    down = np.flatnonzero(level < 0)
    level[down] = lead
    for step in range(lead + 1, BITS + 1):
        if not len(down):
            break
        a, z = _ranges(bits, b[down], np.full(len(down), step))
        down = down[z - a >= descent]
        level[down] = step
    a, z = _ranges(bits, b, level)
    some = z > a
    a, z, q = a[some], z[some], q[some]
    if not len(a):
        return []
    order = np.lexsort((q, z, a))
    a, z, q = a[order], z[order], q[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (z[1:] != z[:-1])))
    first = np.flatnonzero(new)
    n = z[first] - a[first]
    # Rows of each distinct range, by block.
    rows, owner = ragged(a[first], n), np.repeat(np.arange(len(first)), n)
    by_block = np.lexsort((owner, which[rows]))
    rows, owner = rows[by_block], owner[by_block]
    cut = np.flatnonzero(np.concatenate(([True], which[rows][1:] != which[rows][:-1], [True])))
    asking = np.diff(np.concatenate((first, [len(q)])))
    out = []
    for i, j in zip(cut[:-1], cut[1:]):
        some, sizes = np.unique(owner[i:j], return_counts=True)
        who = q[ragged(first[some], asking[some])]
        out.append((int(blocks[which[rows[i]]]), squeeze(sizes.astype("<u4"), pos[rows[i:j]], asking[some].astype("<u4"), who.astype("<i8"))))
    return out


#: Pairs of query and row that a block marks, and that it scores, at once.
MARKED, SCORED = 1 << 23, 1 << 15


def best_of_block(x: np.ndarray, ids: pa.ListArray, y: np.ndarray, q: np.ndarray, own: np.ndarray, least: np.ndarray, messages: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, vec_id, score) of each query's k best among its candidates in a block; ties to smaller ids.

    x: the block's vectors by place; q: ascending numbers of the queries, with vectors y and ids own;
    least: scores below which rows aren't wanted.
    """
    first, pool = ids.offsets.to_numpy(), ids.values.to_numpy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, MARKED // max(len(x), 1))
    opened = [spread(m, "<u4", "<u4", "<u4", "<i8") for m in messages]
    for lo in range(0, len(q), step):
        hi = min(lo + step, len(q))
        mark = np.zeros((hi - lo) * len(x), dtype=bool)
        for sizes, pos, asking, who in opened:
            at = np.searchsorted(q, who)
            here = (at >= lo) & (at < hi)
            begin, sizes = np.cumsum(sizes, dtype=np.int64) - sizes, sizes.astype(np.int64)
            which = np.repeat(np.arange(len(sizes)), asking)[here]
            rows = pos[ragged(begin[which], sizes[which])]
            mark[np.repeat(at[here] - lo, sizes[which]) * len(x) + rows] = True
        pairs = np.flatnonzero(mark)
        of, row = pairs // len(x), pairs % len(x)
        score = np.empty(len(pairs))
        for i in range(0, len(pairs), SCORED):
            score[i : i + SCORED] = (x[row[i : i + SCORED]] * y[lo + of[i : i + SCORED]]).sum(axis=1)
        cut = np.searchsorted(of, np.arange(hi - lo + 1))
        for i, (a, z) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            s, r = score[a:z], row[a:z]
            keep = s >= least[lo + i]
            s, r = s[keep], r[keep]
            if not len(s):
                continue
            if len(s) > k + 1:
                # All rows as good as the (k + 1)-th: one vector may be the query's own.
                keep = s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                s, r = s[keep], r[keep]
            n = first[r + 1] - first[r]
            v, s = pool[ragged(first[r].astype(np.int64), n.astype(np.int64))], np.repeat(s, n)
            other = v != own[lo + i]
            v, s = v[other], s[other]
            best = np.lexsort((v, -s))[:k]
            found.append((np.full(len(best), q[lo + i]), v[best], s[best]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found))


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 20, forest: Forest = Forest()) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k largest inner products found for each query.

    Rows without a usable vector take no part on either side; a query never finds its own id. Fewer
    than k other rows: all of them. Shorter vectors count as padded with zeros. Several rows of one
    query id are searched each. Rows that repeat an id and its vector count once; an id with several
    vectors is a candidate with each of them. Equal scores go to smaller ids. Tables without a row
    give none. Other columns may have any name.
    """
    stage = Stage(spark, "ann")
    base = stage.table(distinct_vectors(usable(vectors), k), "distinct", "snappy")
    asked = usable(queries).select(F.col("vec_id").alias("query_id"), "embedding").dropDuplicates().withColumn("q", F.monotonically_increasing_id())
    asked = stage.table(asked, "asked", "snappy")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    facts = base.agg(F.max(F.size("embedding")).alias("dims"), F.max(norm).alias("largest"), F.count(F.lit(1)).alias("n")).first()
    more = asked.agg(F.max(F.size("embedding")).alias("dims")).first()["dims"]
    if not facts["n"] or more is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, largest = max(facts["dims"], more), facts["largest"]
    base = write_blocks(stage, base, -(-facts["n"] * 8 * dims // forest.block_bytes))
    lead = max(0, min(BITS // 2, math.ceil(math.log2(facts["n"] / forest.part_rows))))
    descent = max(forest.descent, k + 1)
    index, crowd = plant(stage, base, dims, largest, forest, lead)
    strings = stage.table(query_strings(asked, dims, largest, forest, lead), "strings", "snappy")
    keys = ("tree", "part", "salt")

    def visit(visits: DataFrame, asks: DataFrame, name: str) -> DataFrame:
        """q, vec_id, score: k rows at most from each block with candidates of a query, none below
        the least score of asks (q, query_id, embedding, least)."""
        to = visits.join(crowd, ["tree", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        to = to.select(*keys, "b", "q", "level")

        def look(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows and right.num_rows:
                out = candidates_of_part(left.column("body")[0].as_py(), *(right.column(c).to_numpy() for c in ("b", "q", "level")), descent, lead)
            tidy()
            return pa.table({"block": pa.array([b for b, _ in out], type=pa.int64()), "message": pa.array([m for _, m in out], type=pa.binary())})

        told = stage.table(index.groupBy(*keys).cogroup(to.groupBy(*keys)).applyInArrow(look, "block long, message binary"), f"{name}-messages", "snappy")

        def who(key: tuple, table: pa.Table) -> pa.Table:
            of = np.unique(np.concatenate([spread(m, "<u4", "<u4", "<u4", "<i8")[3] for m in table.column("message").to_pylist()]))
            return pa.table({"block": pa.array(np.full(len(of), key[0].as_py())), "q": pa.array(of)})

        vectors_ = told.groupBy("block").applyInArrow(who, "block long, q long").join(asks, "q")
        no = lambda c: F.lit(None).cast(asks.schema[c].dataType).alias(c)
        sent = told.select("block", "message", no("q"), no("query_id"), no("embedding"), no("least"))
        sent = sent.unionByName(vectors_.select("block", F.lit(None).cast("binary").alias("message"), "q", "query_id", "embedding", "least"))

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            out = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
            if left.num_rows and right.num_rows:
                left = left.sort_by("pos")
                asking = right.filter(right.column("q").is_valid()).sort_by("q")
                messages = [m for m in right.column("message").to_pylist() if m is not None]
                ids = left.column("ids").combine_chunks()
                out = best_of_block(_matrix(left.column("embedding"), dims), ids, _matrix(asking.column("embedding"), dims), *(asking.column(c).to_numpy() for c in ("q", "query_id", "least")), messages, k)
            tidy()
            return pa.table({"q": pa.array(out[0], type=pa.int64()), "vec_id": pa.array(out[1], type=pa.int64()), "score": pa.array(out[2], type=pa.float64())})

        return base.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(score, "q long, vec_id long, score double")

    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")

    def best(rows: DataFrame) -> DataFrame:
        return rows.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    any_score = F.lit(float("-inf")).alias("least")
    found = stage.table(best(visit(strings.withColumn("level", F.lit(-1)), asked.select("*", any_score), "descent")), "descent", "snappy")

    def ascend(levels: DataFrame, name: str) -> DataFrame:
        """What is found where all trees share `level` bits with a query; at level 0 all trees are the same.

        levels: q, level and least (score).
        """
        visits = strings.join(levels.drop("least"), "q").filter((F.col("level") > 0) | (F.col("tree") == 0))
        wide = F.pow(F.lit(2), F.greatest(F.lit(lead) - F.col("level"), F.lit(0))).cast("long")
        begin = F.col("part") - F.pmod("part", wide)
        return visit(visits.withColumn("part", F.explode(F.sequence(begin, begin + wide - 1))), asked.join(levels.drop("level"), "q"), name)

    # Where the parts that a query meets have fewer than k rows, it ascends until there are k.
    level = lead
    while level > 0:
        lacking = asked.join(found.filter(F.col("rank") == k).select("q"), "q", "left_anti").select("q", F.lit(level // 2).alias("level"), any_score)
        if lacking.isEmpty():
            break
        level //= 2
        found = stage.table(best(found.select("q", "vec_id", "score").unionByName(ascend(lacking, f"up-{level}"))), f"found-{level}", "snappy")

    # Ascent: the depth at which a row as near as the k-th found so far is missed with probability `miss`.
    # One bit is always shared: what lies in the other half of every tree isn't looked at.
    kth = found.filter(F.col("rank") == k).select("q", "score")
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score") / (norm * F.lit(largest))))
    agree = F.greatest(F.lit(1e-9), 1 - F.acos(cosine) / math.pi)
    depth = F.when(agree >= 1, F.lit(BITS)).otherwise(F.least(F.lit(BITS), F.floor(F.lit(math.log(1 - forest.miss ** (1 / forest.trees))) / F.log(agree))))
    levels = stage.table(asked.join(kth, "q").select("q", F.greatest(F.lit(1), depth.cast("int")).alias("level"), F.col("score").alias("least")), "levels", "snappy")
    last = best(found.select("q", "vec_id", "score").unionByName(ascend(levels, "ascent")))
    return last.join(asked.select("q", "query_id"), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_embeddings(spark: SparkSession, vectors: DataFrame, every: int = 20, k: int = 20, forest: Forest = Forest()) -> DataFrame:
    """Rows whose vec_id is divisible by `every`, searched against all other rows (see search)."""
    queries = need(vectors, "vec_id", "embedding").filter(F.col("vec_id") % every == 0)
    return search(spark, vectors, queries, k, forest)
