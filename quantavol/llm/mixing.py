"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Tokens flow
from patterns to source quotas; the r-th repetition of a pattern's tokens costs r - 1 a token, so
the optimum repeats as little as the quotas allow. The flow is solved on the driver over patterns
(a few rows), then documents are selected by a seeded order within each (pattern, source).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction
from math import inf

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantavol.llm._common import Stage, n_words, need

#: Membership patterns and sources the driver may hold; beyond that the plan is refused, not cut.
MOST_PATTERNS = 200_000
#: Rows (patterns) that are broadcast: some hundred bytes each.
BROADCAST_PATTERNS = 10_000
#: Hash buckets of a pattern's documents; only the bucket in which a share ends is sorted.
BUCKETS = 4096
#: Times that what is missing of a share is filled with documents small enough for it.
ROUNDS = 3
#: What mix() adds to rows, behind a prefix.
ADDED = ("size", "pattern", "source_size", "target", "copies")


def capped_targets(sizes: Sequence[int], weights: Sequence[float], most: int = 3) -> list[float]:
    """Shares of sum(sizes) by weight, none above most times its own size.

    What is cut off is shared again among the others by weight, until none is above. Sources of
    size 0 get 0. If all are at their limit, the sum of targets stays below the sum of sizes.
    """
    left, rest = Fraction(sum(sizes)), {i for i, s in enumerate(sizes) if s > 0}
    out = [Fraction(0)] * len(sizes)
    weight = [Fraction(w) for w in weights]
    while rest:
        total = sum(weight[i] for i in rest)
        share = {i: left * weight[i] / total for i in rest}
        over = {i for i in rest if share[i] > most * sizes[i]}
        if not over:
            for i in rest:
                out[i] = share[i]
            break
        for i in over:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        rest -= over
    return [float(x) for x in out]


def route(supply: Mapping[tuple[int, ...], int], quota: Sequence[int], most: int = 3) -> dict[tuple[tuple[int, ...], int], int]:
    """Min-cost flow: tokens that each pattern gives to each of its sources.

    supply: tokens of a pattern (a sorted tuple of source numbers); quota: tokens a source takes at
    most. A pattern gives at most `most` times its tokens, its r-th time at cost r - 1 a token.
    Successive cheapest augmenting paths; all costs are small integers, so a path is found by
    label-correcting over patterns and sources. Gives a largest flow of least cost.
    """
    patterns = sorted(supply)
    flow: dict[tuple[int, int], int] = {(p, s): 0 for p, pat in enumerate(patterns) for s in pat}
    used = [0] * len(patterns)
    got = [0] * len(quota)
    by_source: dict[int, list[int]] = {}
    for p, pat in enumerate(patterns):
        for s in pat:
            by_source.setdefault(s, []).append(p)

    def level(p: int) -> int:
        return used[p] // supply[patterns[p]] if supply[patterns[p]] else most

    while True:
        # Cheapest way to reach each pattern from the supply side, then sources, with reverse arcs.
        cost_p = [level(p) if level(p) < most else inf for p in range(len(patterns))]
        from_p: list[int | None] = [None] * len(patterns)
        cost_s = [inf] * len(quota)
        from_s: list[int | None] = [None] * len(quota)
        changed = True
        while changed:
            changed = False
            for p, pat in enumerate(patterns):
                for s in pat:
                    if cost_p[p] < cost_s[s]:
                        cost_s[s], from_s[s], changed = cost_p[p], p, True
            for s in range(len(quota)):
                for p in by_source.get(s, []):
                    if flow[p, s] and cost_s[s] < cost_p[p]:
                        cost_p[p], from_p[p], changed = cost_s[s], s, True
        ends = [(cost_s[s], s) for s in range(len(quota)) if got[s] < quota[s] and cost_s[s] < inf]
        if not ends:
            break
        _, s = min(ends)
        end, path, amount = s, [], quota[s] - got[s]
        while True:
            p = from_s[s]
            path.append((p, s, 1))
            if from_p[p] is None:
                size = supply[patterns[p]]
                amount = min(amount, (level(p) + 1) * size - used[p])
                start = p
                break
            s = from_p[p]
            path.append((p, s, -1))
            amount = min(amount, flow[p, s])
        for p, s, sign in path:
            flow[p, s] += sign * amount
        used[start] += amount
        got[end] += amount
    return {(patterns[p], s): x for (p, s), x in flow.items() if x}


def _taken(rounds: int, bucket: Column, row: Column) -> Column:
    """Whether one of the rounds so far takes a document: it was small enough and stands before the round's end."""
    out, size = F.lit(False), row["_size"]
    for k in range(rounds):
        end = F.col(f"_end{k}")
        out = out | ((size <= F.col(f"_fits{k}")) & ((bucket < end) | ((bucket == end) & F.coalesce(row <= F.col(f"_last{k}"), F.lit(False)))))
    return out


def mix(
    spark: SparkSession,
    docs: DataFrame,
    size: Column,
    sources: Column,
    weights: Sequence[float] = (5, 2, 1),
    most: int = 3,
    seed: str = "mix",
    prefix: str = "_",
) -> DataFrame:
    """All rows of docs with _size, _pattern (their sources), _source_size, _target and _copies.

    prefix: what the added names begin with; docs must not have them.

    sources: array of strings, the sources a document belongs to (a null element is a source too;
    a null or empty array counts as the null source). weights repeat over sources by code point,
    null last. Copies are 0 to `most`. Order within a share: md5 of seed and doc_id, then doc_id;
    rows of one doc_id go together in the order of their size. Rows that repeat are taken or left
    together. Null texts have no size and are never taken. Without rows there are none. Reruns give the same rows.
    """
    added = [prefix + c for c in ADDED]
    if clash := {c.lower() for c in added} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs have the names of added columns, give a prefix: {', '.join(sorted(clash))}")
    stage = Stage(spark, "mix")
    doc_id = F.col("doc_id")
    pattern = F.array_sort(F.array_distinct(F.when(F.size(F.coalesce(sources, F.array())) > 0, sources).otherwise(F.array(F.lit(None).cast("string")))))
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    bucket = F.conv(F.substring(order, 1, 3), 16, 10).cast("int")
    # The caller's columns travel in one struct, so that they may have any names.
    facts = (pattern.alias("_pattern"), size.alias("_size"), order.alias("_order"), bucket.alias("_bucket"), doc_id.alias("_doc"))
    rows = docs.select(F.struct("*").alias("_row"), *facts)
    keyed = docs.select(*facts)
    keyed = stage.table(keyed, "keyed")

    # The driver holds a row for each pattern: the sizes, not the documents.
    sums = keyed.groupBy("_pattern").agg(F.sum("_size").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns: merge sources first")
    # Tables with a row a pattern are broadcast where they are small; else joins choose by size as they run.
    small = F.broadcast if len(sums) <= BROADCAST_PATTERNS else (lambda df: df)
    names = sorted({s for r in sums for s in r["_pattern"]}, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    number = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    supply: dict[tuple[int, ...], int] = {}
    for r in sums:
        key = tuple(sorted(number[s] for s in r["_pattern"]))
        supply[key] = supply.get(key, 0) + r["n"]
        for k in key:
            sizes[k] += r["n"]
    total = sum(supply.values())
    # Overlapping documents count in each of their sources; targets share what there is.
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(names))], most)
    scale = total / sum(sizes) if sum(sizes) else 1.0
    targets = [t * scale for t in targets] if sum(sizes) != total else targets
    flows = route(supply, [round(t) for t in targets], most)
    share = {p: sum(x for (q, _), x in flows.items() if q == p) for p in supply}

    text = {p: [names[i] for i in p] for p in supply}
    plan_rows = [(text[p], share[p] // n if n else 0, share[p] % n if n else 0) for p, n in supply.items()]
    plan = spark.createDataFrame(plan_rows, T.StructType([T.StructField("_p", T.ArrayType(T.StringType())), T.StructField("_whole", T.LongType()), T.StructField("_rest", T.LongType())]))
    plan = plan.select(F.array_sort("_p").alias("_p"), "_whole", "_rest")

    # Documents are taken in their order while they fit. What is then missing is filled the same
    # way from those left over that are small enough, a few times, and at last by the one document
    # whose size is nearest to what is missing.
    edge = stage.table(plan.withColumn("_gap", F.col("_rest")), "edge-0", "snappy")
    here = F.struct("_order", "_doc", "_size")
    for k in range(ROUNDS):
        open_ = keyed.join(small(edge), F.col("_pattern").eqNullSafe(F.col("_p"))).filter(~_taken(k, F.col("_bucket"), here) & (F.col("_size") > 0) & (F.col("_size") <= F.col("_gap")))
        # Sizes by (pattern, bucket) show in which bucket a share ends; only that one is put in order.
        w = Window.partitionBy("_p").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = open_.groupBy("_p", "_bucket", "_gap").agg(F.sum("_size").alias("n")).withColumn("_to", F.sum("n").over(w))
        # The first bucket that doesn't fit as a whole; behind the last one if all do.
        first = F.min(F.when(F.col("_to") > F.col("_gap"), F.struct("_bucket", (F.col("_to") - F.col("n")).alias("_before"))))
        ends = sums.groupBy("_p").agg(first.alias("e"), F.max("_to").alias("_all")).select("_p", F.coalesce("e._bucket", F.lit(BUCKETS)).alias("_end"), F.coalesce("e._before", "_all").alias("_before"))
        ends = stage.table(ends, f"ends-{k}", "snappy").withColumnRenamed("_p", "_q")
        inside = open_.join(small(ends), F.col("_p").eqNullSafe(F.col("_q")) & (F.col("_bucket") == F.col("_end")))
        v = Window.partitionBy("_q").orderBy(F.struct("_order", "_doc", "_size")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        cut = inside.withColumn("_sum", F.sum("_size").over(v) + F.col("_before")).filter(F.col("_sum") <= F.col("_gap"))
        cut = cut.groupBy("_q").agg(F.max(here).alias("_last"), F.max("_sum").alias("_filled")).withColumnRenamed("_q", "_r")
        # Bucket and last document to which this round goes, and the sizes that it takes.
        done = edge.join(small(ends), F.col("_p").eqNullSafe(F.col("_q")), "left").join(small(cut), F.col("_p").eqNullSafe(F.col("_r")), "left")
        edge = stage.table(
            done.select(
                *(c for c in edge.columns if c != "_gap"),
                F.col("_gap").alias(f"_fits{k}"), F.coalesce("_end", F.lit(-1)).alias(f"_end{k}"), F.col("_last").alias(f"_last{k}"),
                (F.col("_gap") - F.coalesce("_filled", "_before", F.lit(0))).alias("_gap"),
            ),
            f"edge-{k + 1}", "snappy",
        )
    filler = (
        keyed.join(small(edge), F.col("_pattern").eqNullSafe(F.col("_p")))
        .filter(~_taken(ROUNDS, F.col("_bucket"), here) & (F.abs(F.col("_size") - F.col("_gap")) < F.col("_gap")))
        .groupBy("_p").agg(F.min(F.struct(F.abs(F.col("_size") - F.col("_gap")).alias("_off"), here.alias("_row")))["_row"].alias("_fill"))
    )
    edge = stage.table(edge.join(filler.withColumnRenamed("_p", "_q"), F.col("_p").eqNullSafe(F.col("_q")), "left").drop("_q"), "plan", "snappy")

    info = spark.createDataFrame(
        [(text[p], sizes[p[0]], targets[p[0]]) for p in supply],
        T.StructType([T.StructField("_p", T.ArrayType(T.StringType())), T.StructField("_source_size", T.LongType()), T.StructField("_target", T.DoubleType())]),
    )
    info = info.select(F.array_sort("_p").alias("_q"), "_source_size", "_target")
    row = F.struct("_order", "_doc", "_size")
    extra = _taken(ROUNDS, F.col("_bucket"), row) | F.coalesce(row == F.col("_fill"), F.lit(False))
    return (
        rows.join(small(info), F.col("_pattern").eqNullSafe(F.col("_q")))
        .join(small(edge), F.col("_pattern").eqNullSafe(F.col("_p")), "left")
        .withColumn("_copies", F.coalesce(F.when(F.col("_size") > 0, F.least(F.lit(most).cast("long"), F.col("_whole") + extra.cast("long"))), F.lit(0)).cast("long"))
        .select(*(F.col("_row")[c].alias(c) for c in docs.columns), *(F.col(f"_{c}").alias(a) for c, a in zip(ADDED, added)))
    )


def mix_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Sizes, targets and taken words of every document, sources weighing 5, 2, 1 in turn.

    Null texts have size 0 and are never taken; documents without a source form the last source.
    """
    rows = need(docs, "doc_id", "text", "source").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    rows = Stage(spark, "mix-sizes").table(rows, "sizes")
    mixed = mix(spark, rows, F.col("size"), F.array("source"))
    return mixed.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("size")).alias("taken"))
