"""Katz backoff language model over n-grams.

Counts are discounted by Good-Turing estimates up to `SMALL`, for each order; what is taken from the
seen successors of a context goes to the others in proportion to their probabilities at the order
below, with backoff weights that make every distribution sum to one exactly. The unigram level gives
its own discounted mass to one unknown word. A token's score is looked up recursively: the longest
n-gram, else its context's backoff weight times the score at the order below, down to the unknown word.

Texts become blocks of token numbers, written once. Orders are counted one after another by the same
exchange: an n-gram is a pair of items, the (n - 1)-grams that it begins and ends with (words for
n = 2). A block sends its items and n-grams to the hash parts of the last items, so a part knows
the total counts of both, stores them as its partition of the counts table and answers with the totals;
it sends sums for each first item (the context) to that item's part, which gives den and alpha and
stores them as its partition of the weights table. All that the driver holds are counts of counts. A
very frequent n-gram costs each block one entry. Other texts can be scored from the stored tables alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantavol.llm import _text as t
from quantavol.llm._blocks import MESSAGE, by_part, gaps, planes, spread, squeeze, ungap, unplane
from quantavol.llm._common import Stage, need, partitions, tidy

#: Largest count that is discounted.
SMALL = 5
#: Words of the longest n-grams.
ORDER = 2
BLOCK_BYTES = 10 << 20
#: Words of a block that have the smallest numbers, the most frequent first.
RANKED = 1 << 16
#: Hashes of the marks before and after a text; no word has them but for chance.
BEGIN, END = (int(x) for x in t.seeds(2, 41))


class Discounts(NamedTuple):
    """Factors of counts 0 .. SMALL (index 0 unused) for each order from 1; total counts and the unknown word."""

    factors: tuple[tuple[float, ...], ...]
    tokens: int
    types: int
    den: float
    unknown: float


def good_turing(n: list[int]) -> tuple[float, ...]:
    """Katz's factors d(r) for r = 0 .. SMALL from counts of counts n[r]; where they can't be estimated, 1."""
    out = [1.0] * (SMALL + 1)
    if n[1] > 0:
        tail = (SMALL + 1) * n[SMALL + 1] / n[1]
        for r in range(1, SMALL + 1):
            if n[r] > 0 and tail < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
                if 0 < d <= 1:
                    out[r] = d
    return tuple(out)


def discounts(words: list[int], tokens: int, types: int) -> Discounts:
    """Of order 1, from counts of counts (index r up to SMALL + 1) and totals of the training tokens."""
    word = good_turing(words)
    left = sum(r * (1 - word[r]) * words[r] for r in range(1, SMALL + 1))
    den, left = (float(tokens), left) if left > 0 else (tokens + 1.0, 1.0)
    return Discounts((word,), tokens, types, den, left / den)


def discounted(count: np.ndarray, factors: tuple[float, ...]) -> np.ndarray:
    f = np.array([*factors, 1.0])
    return count * f[np.minimum(count, SMALL + 1)]


def context_weights(total: np.ndarray, small: np.ndarray, large_sum: np.ndarray, lower: np.ndarray, factors: tuple[float, ...], below: tuple[float, ...], below_den: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """(den, alpha) of contexts: a seen successor has discounted count / den, others alpha times their lower probability.

    total: count of the context; small[r - 1]: successors of count r; large_sum: sum of the lower
    counts of successors whose lower count is above SMALL; lower[r - 1]: successors of lower count r;
    below, below_den: factors and den of the order below. What is seen at this order is seen below.
    If nothing is discounted, one more token of the context is set aside for unseen successors.
    """
    taken = sum(r * (1 - factors[r]) * small[r - 1] for r in range(1, SMALL + 1))
    none = taken <= 0
    den = total + none
    left = np.where(none, 1.0, taken) / den
    seen = (large_sum + sum(r * below[r] * lower[r - 1] for r in range(1, SMALL + 1))) / below_den
    return den, left / (1 - seen)


class Level:
    """The n-grams of a block at one order: pairs of items, for each token one.

    items: hashes, ascending; last, prev: for each token the items that its n-gram ends and begins with.
    """

    def __init__(self, items: np.ndarray, last: np.ndarray, prev: np.ndarray, train: np.ndarray, begin: int):
        self.items, self.last, self.prev, self.begin = items, last, prev, begin
        m = len(items)
        self.item_count = np.bincount(last[train], minlength=m)
        self.gram, self.token_gram = np.unique(last * m + prev, return_inverse=True)
        self.gram_count = np.bincount(self.token_gram[train], minlength=len(self.gram))
        self.gram_last, self.gram_prev = self.gram // max(m, 1), self.gram % max(m, 1)

    def next(self, at: np.ndarray, train: np.ndarray, order: int) -> tuple[Level, np.ndarray]:
        """The level above, whose items are these n-grams and a mark before the first of a text; and for
        each of its items the item here that it ends with."""
        a, b, mark = (int(x) for x in t.seeds(3, 50 + order))
        with np.errstate(over="ignore"):
            h = t.mix(self.items[self.gram_prev] * np.uint64(a | 1) + t.mix(self.items[self.gram_last] + np.uint64(b)))
        items, where = np.unique(np.concatenate((h, np.array([mark], dtype=np.uint64))), return_inverse=True)
        ends = np.empty(len(items), dtype=np.int64)
        ends[where] = np.concatenate((self.gram_last, [self.begin]))
        last = where[self.token_gram]
        prev = np.empty_like(last)
        prev[1:] = last[:-1]
        prev[at[:-1]] = where[-1]
        return Level(items, last, prev, train, int(where[-1])), ends

    def shares(self, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(part, items, grams): numbers of the items of a part and of the n-grams that end with them."""
        order, cut = by_part(self.items, parts)
        part = np.empty(len(order), dtype=np.int64)
        part[order] = np.repeat(np.arange(parts), np.diff(cut))
        gram_order = np.argsort(part[self.gram_last], kind="stable")
        gram_cut = np.searchsorted(part[self.gram_last][gram_order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(cut)).tolist():
            yield p, order[cut[p] : cut[p + 1]], gram_order[gram_cut[p] : gram_cut[p + 1]]

    def message(self, items: np.ndarray, grams: np.ndarray, den: np.ndarray) -> Message:
        place = np.zeros(len(self.items), dtype=np.int64)
        place[items] = np.arange(len(items))
        contexts, first = np.unique(self.gram_prev[grams], return_inverse=True)
        return Message(self.items[items], self.item_count[items], den[items], self.items[contexts], first, place[self.gram_last[grams]], self.gram_count[grams])


class Block:
    """Token numbers of a block's documents.

    vocabulary: hashes of words, ascending, with BEGIN and END; level: n-grams of order 2.
    """

    def __init__(self, ids: np.ndarray, absent: np.ndarray, held: np.ndarray, first: np.ndarray, vocabulary: np.ndarray, code: np.ndarray):
        self.ids, self.absent, self.held = ids, absent.astype(bool), held
        n = np.diff(first)
        begin, end = np.searchsorted(vocabulary, np.array([BEGIN, END], dtype=np.uint64))
        self.at = np.concatenate(([0], np.cumsum(n + 1)))
        last = np.full(int(self.at[-1]), end, dtype=np.int64)
        last[t.ragged(self.at[:-1], n)] = code
        prev = np.empty_like(last)
        prev[1:] = last[:-1]
        prev[self.at[:-1]] = begin
        self.train = np.repeat(held == 0, n + 1)
        self.level = Level(vocabulary, last, prev, self.train, int(begin))

    def levels(self, order: int) -> Iterator[tuple[int, Level, np.ndarray]]:
        """(n, level, the item below that each item ends with) for n = 2 .. order."""
        level, ends = self.level, np.zeros(0, dtype=np.int64)
        for n in range(2, order + 1):
            yield n, level, ends
            if n < order:
                level, ends = level.next(self.at, self.train, n)

    @staticmethod
    def pack(ids: np.ndarray, absent: np.ndarray, held: np.ndarray, count: np.ndarray, vocabulary: np.ndarray, code: np.ndarray) -> bytes:
        """Frequent words get small numbers, so that the planes of bytes compress well."""
        n = np.bincount(code, minlength=len(vocabulary))
        top = np.argsort(-n, kind="stable")[:RANKED]
        rest = np.ones(len(n), dtype=bool)
        rest[top] = False
        number = np.empty(len(n), dtype=np.uint32)
        number[top] = np.arange(len(top))
        number[rest] = np.arange(len(top), len(n))
        return squeeze(ids.astype("<i8"), absent.astype(np.uint8), held.astype(np.uint8), count.astype("<u4"), gaps(vocabulary), planes(top), planes(number[code]))

    @staticmethod
    def open(body: bytes) -> Block:
        ids, absent, held, count, vocabulary, top, number = spread(body, "<i8", "u1", "u1", "<u4", "<u8", "u1", "u1")
        vocabulary, top = ungap(vocabulary), unplane(top)
        rest = np.ones(len(vocabulary), dtype=bool)
        rest[top] = False
        code = np.concatenate((top.astype(np.int64), np.flatnonzero(rest)))[unplane(number)]
        return Block(ids, absent, held, np.concatenate(([0], np.cumsum(count, dtype=np.int64))), vocabulary, code)


def _totals(value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, their sums, and for each entry the number of its value."""
    distinct, back = np.unique(value, return_inverse=True)
    return distinct, np.bincount(back, weights=weight, minlength=len(distinct)).astype(np.int64), back


def write_blocks(stage: Stage, docs: DataFrame) -> DataFrame:
    """Rows (block, body) of documents (doc_id, text, held)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def close() -> pa.RecordBatch:
            ids, out, count, h = (np.concatenate(x) for x in list(zip(*held))[:4])
            absent = np.concatenate([x[4] for x in held])
            marks = np.array([BEGIN, END], dtype=np.uint64)
            vocabulary, code = np.unique(np.concatenate((h, marks)), return_inverse=True)
            body = Block.pack(ids, absent, out, count, vocabulary, code[:-2])
            return pa.RecordBatch.from_pydict({"block": pa.array([uuid.uuid4().int >> 65], type=pa.int64()), "body": pa.array([body], type=pa.binary())})

        for batch in batches:
            for i, j in t.slices(batch.column("text")):
                w = t.split_words(batch.column("text").slice(i, j - i), lower=True)
                h = t.word_hashes(w) if len(w.start) else np.zeros(0, dtype=np.uint64)
                ids = batch.column("doc_id").slice(i, j - i)
                held.append((ids.fill_null(0).to_numpy(), batch.column("held").slice(i, j - i).to_numpy(zero_copy_only=False), w.counts, h, ids.is_null().to_numpy(zero_copy_only=False)))
                size += len(w.data)
                if size >= BLOCK_BYTES:
                    yield close()
                    held.clear()
                    size = 0
        if held:
            yield close()
        tidy()

    return stage.table(docs.mapInArrow(run, "block long, body binary"), "blocks", "snappy")


class Message(NamedTuple):
    """Items and n-grams of a part, from a block or in the counts table.

    items, their counts and the den of the order below (0 at order 2); hashes of first items
    (contexts), and for each n-gram the numbers of its first and last item in these lists, and its count.
    """

    items: np.ndarray
    item_count: np.ndarray
    below: np.ndarray
    contexts: np.ndarray
    first: np.ndarray
    last: np.ndarray
    gram_count: np.ndarray

    def pack(self) -> bytes:
        """N-grams must be in ascending order of their last items."""
        return squeeze(planes(gaps(self.items), 8), planes(self.item_count, 8), planes(self.below, 8), planes(gaps(self.contexts), 8), planes(self.first), planes(gaps(self.last.astype(np.int64))), planes(self.gram_count, 8))

    @staticmethod
    def open(body: bytes) -> Message:
        items, n, below, contexts, first, last, m = spread(body, *["u1"] * 7)
        return Message(ungap(unplane(items, 8)), unplane(n, 8), unplane(below, 8), ungap(unplane(contexts, 8)), unplane(first), ungap(unplane(last).astype(np.int64)), unplane(m, 8))


#: Kinds of what a part gives: its partitions of the model's counts and weights; totals and weights for
#: blocks; sums for contexts; counts of counts; which of the part's items each block has; all items.
COUNTS, TABLE, TOTALS, WEIGHTS, SUMS, STATISTICS, ASKED, ITEMS = range(8)
KINDS = f"kind int, {MESSAGE}"


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    kind, block, part, body = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"kind": pa.array(kind, type=pa.int32()), "block": pa.array(block, type=pa.int64()), "part": pa.array(part, type=pa.int32()), "body": pa.array(body, type=pa.binary())})


def count_part(table: pa.Table, parts: int) -> pa.Table:
    """Everything that a part tells of its items and n-grams (see the kinds)."""
    blocks, part = table.column("block").to_pylist(), table.column("part")[0].as_py()
    got = [Message.open(b) for b in table.column("body").to_pylist()]
    items = np.cumsum([0, *(len(g.items) for g in got)])
    grams = np.cumsum([0, *(len(g.first) for g in got)])
    key, count, back = _totals(np.concatenate([g.items for g in got]), np.concatenate([g.item_count for g in got]))
    below = np.zeros(len(key), dtype=np.int64)
    below[back] = np.concatenate([g.below for g in got])
    contexts, which = np.unique(np.concatenate([g.contexts for g in got]), return_inverse=True)
    seen_at = np.cumsum([0, *(len(g.contexts) for g in got)])
    first = np.concatenate([which[a:z][g.first] for g, a, z in zip(got, seen_at[:-1], seen_at[1:])])
    last = np.concatenate([back[a:z][g.last] for g, a, z in zip(got, items[:-1], items[1:])])
    m = max(len(contexts), 1)
    gram, gram_count, gram_back = _totals(last * m + first, np.concatenate([g.gram_count for g in got]))
    out: list[tuple[int, int, int, bytes]] = []
    for b, a, z, c, d in zip(blocks, items[:-1], items[1:], grams[:-1], grams[1:]):
        out.append((TOTALS, b, part, squeeze(planes(count[back[a:z]], 8), planes(gram_count[gram_back[c:d]], 8))))
        out.append((ASKED, b, part, squeeze(planes(gaps(back[a:z])))))
    out.append((ITEMS, 0, part, squeeze(gaps(key), planes(below, 8))))
    seen = gram_count > 0
    gram, gram_count = gram[seen], gram_count[seen]
    item, first = gram // m, gram % m
    trained = np.flatnonzero(count > 0)
    place = np.cumsum(count > 0) - 1
    used, number = np.unique(first, return_inverse=True)
    out.append((COUNTS, 0, part, Message(key[trained], count[trained], np.zeros(0, dtype=np.int64), contexts[used], number, place[item], gram_count).pack()))
    stats = [np.bincount(np.minimum(c, SMALL + 2), minlength=SMALL + 3)[: SMALL + 2] for c in (count[trained], gram_count)]
    out.append((STATISTICS, 0, part, np.concatenate((*stats, [count.sum(), len(trained)])).astype("<i8").tobytes()))

    n, lower = len(used), count[item]
    sums = [np.bincount(number, weights=gram_count, minlength=n)]
    sums += [np.bincount(number[gram_count == r], minlength=n) for r in range(1, SMALL + 1)]
    sums.append(np.bincount(number, weights=np.where(lower > SMALL, lower, 0), minlength=n))
    sums += [np.bincount(number[lower == r], minlength=n) for r in range(1, SMALL + 1)]
    sums = [s.astype("<i8") for s in sums]
    order, cut = by_part(contexts[used], parts)
    for p in np.flatnonzero(np.diff(cut)).tolist():
        here = order[cut[p] : cut[p + 1]]
        out.append((SUMS, 0, p, squeeze(gaps(contexts[used][here]), *(s[here] for s in sums))))
    tidy()
    return _rows(out)


def weigh_contexts(sums: pa.Table, asked: pa.Table, d: Discounts, order: int) -> pa.Table:
    """den and log10 alpha of a part's contexts (TABLE), and for each block's items of the part
    (WEIGHTS); 1 and 0 for items that no training text has before another token."""
    if not asked.num_rows:
        return _rows([])
    part, got = asked.column("part")[0].as_py(), [spread(b, "<u8", *["<i8"] * (2 * SMALL + 2)) for b in sums.column("body").to_pylist()]
    distinct, back = np.unique(np.concatenate([ungap(g[0]) for g in got]) if got else np.zeros(0, dtype=np.uint64), return_inverse=True)
    add = [np.bincount(back, weights=np.concatenate([g[1 + i] for g in got]), minlength=len(distinct)) if got else np.zeros(0) for i in range(2 * SMALL + 2)]
    kinds, bodies = asked.column("kind").to_pylist(), asked.column("body").to_pylist()
    items, below = spread(next(b for k, b in zip(kinds, bodies) if k == ITEMS), "<u8", "u1")
    items, below = ungap(items), unplane(below, 8).astype(np.float64)
    below_den = d.den if order == 2 else below[np.searchsorted(items, distinct)]
    den, alpha = context_weights(add[0], add[1 : SMALL + 1], add[SMALL + 1], add[SMALL + 2 :], d.factors[order - 1], d.factors[order - 2], below_den)
    den, log_alpha = den.astype(np.int64), np.log10(alpha)
    out = [(TABLE, 0, part, squeeze(planes(gaps(distinct), 8), planes(den, 8), _byte_planes(log_alpha)))]
    own_den, own_alpha = _of_contexts(items, distinct, den, log_alpha)
    for b, k, body in zip(asked.column("block").to_pylist(), kinds, bodies):
        if k == ASKED:
            here = ungap(unplane(spread(body, "u1")[0]))
            out.append((WEIGHTS, b, part, squeeze(planes(own_den[here], 8), _byte_planes(own_alpha[here]))))
    return _rows(out)


def _of_contexts(items: np.ndarray, contexts: np.ndarray, den: np.ndarray, log_alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """den and log10 alpha of items among ascending contexts."""
    at = _find(items, contexts)
    return np.append(den, 1)[at], np.append(log_alpha, 0.0)[at]


def _find(keys: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Where keys stand; the length where they don't."""
    if not len(ascending):
        return np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(ascending, keys), len(ascending) - 1)
    return np.where(ascending[at] == keys, at, len(ascending))


def _byte_planes(values: np.ndarray) -> np.ndarray:
    """Doubles as eight planes of bytes: those of sign and exponent are almost constant."""
    return np.ascontiguousarray(values.astype("<f8").view(np.uint8).reshape(-1, 8).T).reshape(-1)


def _of_byte_planes(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(8, -1).T).reshape(-1).view("<f8")


def _told(table: pa.Table) -> dict[tuple[int, int, int], bytes]:
    """Bodies by (order, kind, part)."""
    return dict(zip(zip(*(table.column(c).to_pylist() for c in ("order", "kind", "part"))), table.column("body").to_pylist()))


def _den_of_items(level: Level, told: dict[tuple[int, int, int], bytes], order: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    den, log_alpha = np.ones(len(level.items), dtype=np.int64), np.zeros(len(level.items))
    for p, items, _ in level.shares(parts):
        n, a = spread(told[order, WEIGHTS, p], "u1", "u1")
        den[items], log_alpha[items] = unplane(n, 8), _of_byte_planes(a)
    return den, log_alpha


def score_block(block: Block, answers: pa.Table, parts: int, d: Discounts, order: int) -> dict[str, np.ndarray]:
    """Sums of each document of a block: tokens, known tokens, base and model log10 probabilities."""
    told = _told(answers)
    for n, level, _ in block.levels(order):
        items, grams = np.zeros(len(level.items), dtype=np.int64), np.zeros(len(level.gram), dtype=np.int64)
        for p, i, g in level.shares(parts):
            items[i], grams[g] = (unplane(x, 8) for x in spread(told[n, TOTALS, p], "u1", "u1"))
        if n == 2:
            known = items[level.last]
            base = np.log10((known + 0.5) / (d.tokens + 0.5 * (d.types + 1)))
            token = np.where(items > 0, np.log10(np.maximum(discounted(items, d.factors[0]), 1e-300) / d.den), np.log10(d.unknown))[level.last]
        # Recursion: the n-gram if it was seen, else its context's weight and the score below.
        den, log_alpha = _den_of_items(level, told, n, parts)
        count, prev = grams[level.token_gram], level.prev
        seen = np.log10(np.maximum(discounted(grams, d.factors[n - 1]), 1e-300))[level.token_gram] - np.log10(den)[prev]
        token = np.where(count > 0, seen, log_alpha[prev] + token)
    n = len(block.ids)
    if not n:
        return {"n_tokens": np.zeros(0, dtype=np.int64), "n_known": np.zeros(0, dtype=np.int64), "base": np.zeros(0), "score": np.zeros(0)}
    at = block.at[:-1]
    return {
        "n_tokens": np.diff(block.at),
        "n_known": np.add.reduceat((known > 0).astype(np.int64), at),
        "base": np.add.reduceat(base, at),
        "score": np.add.reduceat(token, at),
    }


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(body: bytes, answers: pa.Table, parts: int, d: Discounts, order: int) -> pa.Table:
    b = Block.open(body)
    got = score_block(b, answers, parts, d, order)
    tidy()
    return pa.table({"doc_id": pa.array(b.ids, mask=b.absent), "held_out": pa.array(b.held.astype(bool)), "n_tokens": got["n_tokens"], "n_known": got["n_known"], "train_tokens": np.full(len(b.ids), d.tokens), "base_score": got["base"], "score": got["score"]})


class Model(NamedTuple):
    """A trained model: tables (order, kind, part, body) of counts and weights, a row for each part.

    order: the longest n-grams; parts: hash parts; discounts: what the driver holds.
    """

    tables: DataFrame
    order: int
    parts: int
    discounts: Discounts

    def score(self, spark: SparkSession, docs: DataFrame) -> DataFrame:
        """Scores of other documents, evaluated from the stored tables: a block asks the parts for its
        items and n-grams, and the parts look them up. Columns and nulls as in score_documents; held_out is true."""
        stage = Stage(spark, "katz-score")
        blocks = write_blocks(stage, need(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(1).cast("byte").alias("held")))
        order, parts, d = self.order, self.parts, self.discounts

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, body in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist()):
                    for n, level, _ in Block.open(body).levels(order):
                        rows = [(0, name, p, level.message(i, g, np.zeros(len(level.items), dtype=np.int64)).pack()) for p, i, g in level.shares(parts)]
                        yield from _rows(rows).append_column("order", pa.array(np.full(len(rows), n, dtype=np.int32))).select(ORDERED).to_batches()

        asked = blocks.mapInArrow(ask, ORDERED_KINDS)
        keys = ("order", "part")
        told = asked.groupBy(*keys).cogroup(self.tables.groupBy(*keys)).applyInArrow(look_up, ORDERED_KINDS)
        finish = lambda left, right: _scored(left.column("body")[0].as_py(), right, parts, d, order)
        return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(finish, SCORES)


ORDERED = ["order", "kind", "block", "part", "body"]
ORDERED_KINDS = f"order int, {KINDS}"


def look_up(asked: pa.Table, stored: pa.Table) -> pa.Table:
    """Totals and weights for each message of a part, from the part's rows of the model's tables."""
    if not asked.num_rows:
        return pa.table({c: pa.array([], type=k) for c, k in zip(ORDERED, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))})
    bodies = dict(zip(stored.column("kind").to_pylist(), stored.column("body").to_pylist()))
    none = np.zeros(0, dtype=np.int64)
    model = Message.open(bodies[COUNTS]) if COUNTS in bodies else Message(none.astype(np.uint64), none, none, none.astype(np.uint64), none, none, none)
    contexts, den, log_alpha = none.astype(np.uint64), none, none.astype(np.float64)
    if TABLE in bodies:
        contexts, den, log_alpha = spread(bodies[TABLE], "u1", "u1", "u1")
        contexts, den, log_alpha = ungap(unplane(contexts, 8)), unplane(den, 8), _of_byte_planes(log_alpha)
    m = max(len(model.contexts), 1)
    grams = model.last * m + model.first
    part, out = asked.column("part")[0].as_py(), []
    for block, body in zip(asked.column("block").to_pylist(), asked.column("body").to_pylist()):
        q = Message.open(body)
        item, context = _find(q.items, model.items), _find(q.contexts, model.contexts)
        last, first = item[q.last], context[q.first]
        gram = np.where((last < len(model.items)) & (first < len(model.contexts)), last * m + first, -1)
        totals = np.append(model.item_count, 0)[item], np.append(model.gram_count, 0)[_find(gram, grams)]
        weights = _of_contexts(q.items, contexts, den, log_alpha)
        out += [(TOTALS, block, part, squeeze(planes(totals[0], 8), planes(totals[1], 8))), (WEIGHTS, block, part, squeeze(planes(weights[0], 8), _byte_planes(weights[1])))]
    rows = _rows(out)
    return rows.append_column("order", pa.array(np.full(len(out), asked.column("order")[0].as_py(), dtype=np.int32))).select(ORDERED)


def _train(stage: Stage, blocks: DataFrame, n_blocks: int, order: int) -> tuple[Model, DataFrame]:
    """The model of the blocks' training texts, and what its parts tell the blocks (order, kind, block, part, body)."""
    spark = stage.spark
    # A part holds about as much as two blocks, however large the corpus; fewer parts repeat fewer contexts.
    parts = max(partitions(spark), -(-n_blocks // 2))
    told: list[DataFrame] = []
    tables: list[DataFrame] = []
    d: Discounts | None = None

    def ask(n: int, name: int, body: bytes, weights: pa.Table | None) -> pa.Table:
        for k, level, ends in Block.open(body).levels(n):
            if k == n - 1:
                below = _den_of_items(level, _told(weights), k, parts)[0]
            elif k == n:
                den = below[ends] if n > 2 else np.zeros(len(level.items), dtype=np.int64)
                rows = [(0, name, p, level.message(i, g, den).pack()) for p, i, g in level.shares(parts)]
        tidy()
        return _rows(rows).drop_columns("kind")

    def again(n: int):
        return lambda left, right: ask(n, left.column("block")[0].as_py(), left.column("body")[0].as_py(), right)

    def weigh(d: Discounts, n: int):
        return lambda left, right: weigh_contexts(left, right, d, n)

    for n in range(2, order + 1):
        if n == 2:

            def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for name, body in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist()):
                        yield from ask(2, name, body, None).to_batches()

            sent = blocks.mapInArrow(first, MESSAGE)
        else:
            sent = blocks.groupBy("block").cogroup(told[-1].groupBy("block")).applyInArrow(again(n), MESSAGE)
        counted = sent.groupBy("part").applyInArrow(lambda table: count_part(table, parts), KINDS)
        # A folder for each kind, so that only what is asked for is read.
        counted.write.partitionBy("kind").option("compression", "snappy").parquet(f"{stage.path}/counts-{n}")
        kind = lambda k, n=n: spark.read.schema(MESSAGE).parquet(f"{stage.path}/counts-{n}/kind={k}").withColumn("kind", F.lit(k))
        stats = kind(STATISTICS).mapInArrow(_add_stats, "body binary").collect()
        total = np.sum([np.frombuffer(r["body"], dtype="<i8") for r in stats], axis=0).tolist()
        m = SMALL + 2
        if d is None:
            d = discounts(total[:m], total[2 * m], total[2 * m + 1])
        d = d._replace(factors=(*d.factors, good_turing(total[m : 2 * m])))
        sums = kind(SUMS) if total[2 * m] > 0 else spark.createDataFrame([], f"{MESSAGE}, kind int")
        asked = kind(ASKED).unionByName(kind(ITEMS))
        weighed = sums.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(weigh(d, n), KINDS)
        weighed.write.partitionBy("kind").option("compression", "snappy").parquet(f"{stage.path}/weights-{n}")
        stage.drop(f"counts-{n}/kind={SUMS}", f"counts-{n}/kind={ASKED}", f"counts-{n}/kind={ITEMS}")
        at_order = lambda df, n=n: df.withColumn("order", F.lit(n)).select(*ORDERED)
        of_weights = lambda k, n=n: spark.read.schema(MESSAGE).parquet(f"{stage.path}/weights-{n}/kind={k}").withColumn("kind", F.lit(k))
        told += [at_order(kind(TOTALS)), at_order(of_weights(WEIGHTS))]
        tables += [at_order(kind(COUNTS)), at_order(of_weights(TABLE))]
    return Model(_all(tables), order, parts, d), _all(told)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _numbered(docs: DataFrame, held_out) -> DataFrame:
    return need(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).cast("byte").alias("held"))


def train(spark: SparkSession, docs: DataFrame, order: int = ORDER) -> Model | None:
    """The model of all documents, stored in the shared folder; None without documents."""
    if order < 2:
        raise ValueError("order must be at least 2")
    stage = Stage(spark, "katz-model")
    blocks = write_blocks(stage, _numbered(docs, F.lit(False)))
    n_blocks = blocks.count()
    return _train(stage, blocks, n_blocks, order)[0] if n_blocks else None


def score_documents(spark: SparkSession, docs: DataFrame, held_out, order: int = ORDER) -> DataFrame:
    """Trains on rows whose held_out is false and scores all rows by n-grams of up to `order` words.

    doc_id (an integer or null), held_out, n_tokens, n_known, train_tokens, base_score and score. Words
    are runs outside [\\x20\\x09-\\x0D] with A-Z lowered, and every text has one end token; null and
    empty texts are the end token alone. Without training rows every token is unknown. Rows that
    repeat count as texts of their own. Without rows there are none; other columns may have any name.
    Blocks get totals and weights from the parts in the passes that store them.
    """
    if order < 2:
        raise ValueError("order must be at least 2")
    stage = Stage(spark, "katz")
    blocks = write_blocks(stage, _numbered(docs, held_out))
    n_blocks = blocks.count()
    if not n_blocks:
        return spark.createDataFrame([], SCORES)
    model, told = _train(stage, blocks, n_blocks, order)
    parts, d = model.parts, model.discounts
    finish = lambda left, right: _scored(left.column("body")[0].as_py(), right, parts, d, order)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(finish, SCORES)


def _add_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of sums a task."""
    total = None
    for batch in batches:
        for body in batch.column("body").to_pylist():
            row = np.frombuffer(body, dtype="<i8")
            total = row if total is None else total + row
    if total is not None:
        yield pa.RecordBatch.from_pydict({"body": pa.array([total.astype("<i8").tobytes()], type=pa.binary())})
