"""Learned decision lists for text quality.

Sequential covering learns an ordered list of conjunctions of thresholds from labelled
statistics: each rule grows greedily on two thirds of the uncovered rows (FOIL gain), is pruned on
the other third, and its covered rows are set aside. The list becomes one Spark conditional
expression, so scoring needs no Python beyond the text statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantavol.llm import _text as t
from quantavol.llm._common import Stage, fresh, need, tidy

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that rules may test, besides those of the contract; all are ratios or lengths.
RATIOS = ("chars_a_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share", "lone_share", "words_a_line", "distinct_share", "longest_word")
SYMBOLS = b"#*$%&|<>"


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


IS_SYMBOL = _flags(SYMBOLS)
IS_UPPER = _flags(bytes(range(65, 91)))
IS_DIGIT = _flags(b"0123456789")
IS_PUNCT = _flags(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
IS_LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])


def _doc_sums(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
    if len(at) <= 4:  # few, perhaps very long texts: no running sum over all bytes
        return np.array([np.count_nonzero(flag[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist())], dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def _earlier_equal(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an equal key stands earlier; whether a key stands twice or more."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.concatenate(([False], k[1:] == k[:-1])) if len(k) else np.zeros(0, dtype=bool)
    earlier = np.zeros(len(k), dtype=bool)
    earlier[order] = same
    twice = np.zeros(len(k), dtype=bool)
    twice[order] = same | np.concatenate((same[1:], [False]))[: len(k)]
    return earlier, twice


def text_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and RATIOS of each text of a slice (see statistics())."""
    w = t.split_words(column)
    n = len(w.doc_at) - 1
    data, at, counts = w.data, w.doc_at, w.counts
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        lead = IS_LEAD[data]
        space = t.IS_SPACE[data]
        chars = _doc_sums(lead & ~space, at)
        symbols = _doc_sums(IS_SYMBOL[data], at)
        h = t.word_hashes(w)
        doc = w.doc_of()
        salt = t.seeds(n, 3) if n else np.zeros(0, dtype=np.uint64)

        # Lines: \n-split spans of each text with a word in them.
        cut = np.flatnonzero(data == 10)
        cut_doc = np.searchsorted(at, cut, side="right") - 1
        starts = np.concatenate((at[:-1], cut + 1))
        owner = np.concatenate((np.arange(n), cut_doc))
        order = np.lexsort((starts, owner))
        starts, owner = starts[order], owner[order]
        ends = np.concatenate((cut, at[1:]))[np.lexsort((np.concatenate((cut, at[1:])), np.concatenate((cut_doc, np.arange(n)))))]
        has = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
        starts, ends, owner = starts[has], ends[has], owner[has]
        earlier, _ = _earlier_equal(t.mix(t.span_hashes(data, starts, ends) ^ salt[owner]) if len(starts) else np.zeros(0, dtype=np.uint64))
        dup_lines = np.bincount(owner[earlier], minlength=n)
        lines = np.bincount(owner, minlength=n)

        # Words in 3-word windows that stand twice or more in their text.
        total = len(h)
        covered = np.zeros(total, dtype=bool)
        whole = t.whole_gram_mask(w.first, 3)
        if whole.any():
            place = np.flatnonzero(whole)
            _, twice = _earlier_equal(t.mix(t.gram_hashes(h, 3)[place] ^ salt[doc[place]]))
            hit = place[twice]
            for k in range(3):
                covered[hit + k] = True
        repeat = np.bincount(doc[covered], minlength=n)
        seen, _ = _earlier_equal(t.mix(h ^ salt[doc]) if total else h)
        distinct = np.bincount(doc[~seen], minlength=n)

        length = w.end - w.start
        lone = np.bincount(doc[length == 1], minlength=n)
        longest = np.zeros(n, dtype=np.int64)
        np.maximum.at(longest, doc, length)
        share = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
        return {
            "n_words": counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat,
            "chars_a_word": share(chars, counts), "symbol_share": share(symbols, chars), "dup_line_share": share(dup_lines, lines),
            "repeat_share": share(repeat, counts), "upper_share": share(_doc_sums(IS_UPPER[data], at), chars),
            "digit_share": share(_doc_sums(IS_DIGIT[data], at), chars), "punct_share": share(_doc_sums(IS_PUNCT[data], at), chars),
            "lone_share": share(lone, counts), "words_a_line": share(counts, lines), "distinct_share": share(distinct, counts),
            "longest_word": longest.astype(np.float64),
        }


def statistics(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The carried columns, COUNTS and RATIOS of every document, in one read of the text and without
    a shuffle. prefix: before the names of statistics, where carried columns have the same.

    Null and empty texts have zeros throughout. word_chars: code points in words; n_symbols:
    characters of [#*$%&|<>]; n_dup_lines: lines with a word that equal an earlier line of the
    text; n_repeat_words: words in 3-word windows found twice or more in the text, first included.
    """
    (text_,) = fresh(list(carry), "text")
    names = [prefix + c for c in (*COUNTS, *RATIOS)]
    kinds = [T.LongType()] * len(COUNTS) + [T.DoubleType()] * len(RATIOS)
    schema = T.StructType([*(docs.schema[c] for c in carry), *(T.StructField(c, k) for c, k in zip(names, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_)
            for i, j in t.slices(texts):
                got = text_statistics(texts.slice(i, j - i))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in carry), *(pa.array(got[c].astype(np.int64)) for c in COUNTS), *(pa.array(got[c].astype(np.float64)) for c in RATIOS)],
                    names=[*carry, *names],
                )
            tidy()

    return docs.select(*need(docs, *carry).columns, F.col("text").cast("string").alias(text_)).mapInArrow(run, schema)


class Condition(NamedTuple):
    """column <= limit, or column > limit."""

    column: str
    above: bool
    limit: float

    def expression(self, prefix: str = "") -> Column:
        c = F.col(prefix + self.column)
        return c > F.lit(self.limit) if self.above else c <= F.lit(self.limit)

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.column)]
        return v > self.limit if self.above else v <= self.limit

    def __str__(self) -> str:
        return f"{self.column} {'>' if self.above else '<='} {self.limit:.6g}"


class DecisionList(NamedTuple):
    """Rules in order; the first that holds rejects a row, and what none covers is kept."""

    rules: list[tuple[Condition, ...]]

    def kept(self, prefix: str = "") -> Column:
        out = None
        for rule in self.rules:
            both = F.lit(True)
            for c in rule:
                both = both & c.expression(prefix)
            out = F.when(both, F.lit(False)) if out is None else out.when(both, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, r))}" for r in self.rules) + "\nkeep"


def _thresholds(v: np.ndarray, most: int) -> np.ndarray:
    u = np.unique(v)
    if len(u) < 2:
        return u[:0]
    mid = (u[1:] + u[:-1]) / 2
    return mid if len(mid) <= most else np.quantile(mid, np.linspace(0, 1, most))


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], most_conditions: int, cuts: int) -> list[Condition]:
    """Conditions that raise the FOIL gain most, one at a time, until only positives are covered."""
    rule: list[Condition] = []
    live = np.ones(len(y), dtype=bool)
    while len(rule) < most_conditions and (~y[live]).any():
        p0, n0 = y[live].sum(), (~y[live]).sum()
        if not p0:
            break
        base = np.log2(p0 / (p0 + n0))
        best: tuple[float, Condition | None] = (1e-9, None)
        for j, name in enumerate(names):
            v = x[live, j]
            limits = _thresholds(v, cuts)
            if not len(limits):
                continue
            pos, neg = np.sort(v[y[live]]), np.sort(v[~y[live]])
            low_p, low_n = np.searchsorted(pos, limits, side="right"), np.searchsorted(neg, limits, side="right")
            for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), Condition(name, above, float(limits[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= best[1].holds(x, names)
    return rule


def _covers(rule: list[Condition], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x, names)
    return out


def learn(x: np.ndarray, reject: np.ndarray, names: list[str], min_precision: float = 0.9, min_cover: int = 5, most_rules: int = 24, most_conditions: int = 4, cuts: int = 64) -> DecisionList:
    """Sequential covering of the rows to reject. x: rows by names; ties in gain: the first column.

    A pruned rule stays if at least min_precision of what it covers, over all rows that are left,
    is to be rejected, and at least min_cover rows are.
    """
    rules: list[tuple[Condition, ...]] = []
    part = np.arange(len(reject)) % 3 == 2
    left = np.ones(len(reject), dtype=bool)
    while len(rules) < most_rules and reject[left].sum() >= min_cover:
        grow, prune = left & ~part, left & part
        rule = _grow(x[grow], reject[grow], names, most_conditions, cuts)
        if not rule:
            break

        def worth(r: list[Condition]) -> float:
            hit = _covers(r, x[prune], names)
            p, n = reject[prune][hit].sum(), (~reject[prune][hit]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1:
            shorter = max((rule[:k] for k in range(1, len(rule))), key=worth)
            if worth(shorter) < worth(rule):
                break
            rule = shorter
        hit = _covers(rule, x, names) & left
        p = reject[hit].sum()
        if p < min_cover or p / hit.sum() < min_precision:
            break
        rules.append(tuple(rule))
        left &= ~hit
    return DecisionList(rules)


def labelled_sample(labels: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """At most most_rows rows (doc_id, quality) of labels, those first by a hash of doc_id.

    Labels with a null doc_id or quality are left out; of several labels of one document the
    lowest quality counts.
    """
    marks = need(labels, "doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # The sample is what falls into a share of all hashes, so that few rows are sorted.
    grain, order = 1 << 20, F.xxhash64("doc_id")
    share = min(grain, math.ceil(grain * 1.05 * most_rows / max(marks.count(), 1)))
    return marks.filter(F.pmod(order, F.lit(grain)) < share).orderBy(order, "doc_id").limit(most_rows)


def fit(features: DataFrame, most_rows: int = 20_000, **options) -> DecisionList:
    """Learns from statistics of labelled rows: features has doc_id, quality, COUNTS and RATIOS.

    At most most_rows rows count, those first by a hash of doc_id, as documents may repeat. Without
    any the list is empty and keeps everything.
    """
    names = [*COUNTS, *RATIOS]
    order = F.xxhash64("doc_id").alias("at")
    rows = features.select("quality", order, *(F.col(n).cast("double") for n in names))
    got = rows.orderBy("at", *names).limit(most_rows).toPandas()
    if not len(got):
        return DecisionList([])
    return learn(got[names].to_numpy(dtype=np.float64), got["quality"].to_numpy() == 0, names, **options)


def base_failed(prefix: str = "") -> Column:
    n, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, **options) -> tuple[DataFrame, DecisionList]:
    """Counts, base_failed and kept of every document, and the list that decided.

    Null and empty texts have no words and fail the base rules. Rows that repeat are judged each,
    null doc_ids like any other, but no label is theirs. Without documents there are no rows.
    """
    stage = Stage(spark, "quality")
    features = stage.table(statistics(docs), "features")
    # The sample is at most most_rows rows, so it can be sent to every task.
    sample = stage.table(labelled_sample(labels, most_rows), "sample", "snappy")
    rules = fit(features.join(F.broadcast(sample), "doc_id"), most_rows, **options)
    out = features.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & rules.kept()).alias("kept"))
    return out, rules


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, **options) -> DataFrame:
    """The rows of docs that neither fail the base rules nor are rejected by the learned list, unchanged.

    Statistics of the labelled sample are computed first, then all texts are read once. Columns
    may have any names; nulls, repeats and empty tables as in judge().
    """
    sample = Stage(spark, "quality").table(labelled_sample(labels, most_rows), "sample", "snappy")
    labelled = need(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")
    rules = fit(statistics(labelled, ("doc_id", "quality")), most_rows, **options)
    prefix = "quality_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    judged = statistics(docs, tuple(docs.columns), prefix)
    return judged.filter(~base_failed(prefix) & rules.kept(prefix)).select(*(F.col(f"`{c}`") for c in docs.columns))
