"""Removal of passages that stand earlier in the corpus, by repeated-phrase automata.

Texts travel as compressed blocks of some megabytes, written once; blocks of one task form groups.
Groups and hash parts exchange packed messages:

1. Every window of `width` words names its smallest hash of half as many words (winnowing), so equal
   windows name equal anchors. A part answers which anchors stand in two places or more.
2. Groups send the windows of recurring anchors. A part confirms which windows recur, which word
   comes before and after all their occurrences, and which block holds the first one. Windows that
   always follow each other are one passage: all its occurrences are those of its first window,
   shifted, so the group that holds the first occurrence writes that window as the passage's phrase.
3. Phrases are dealt to the parts by anchor. A part compiles its shard of all phrases of the corpus to
   Aho-Corasick automata of a bounded number of phrases, over words as characters. Documents are
   streamed through them: every stretch with a recurring anchor goes to the part of that anchor, as
   any occurrence of a phrase lies in a stretch with the phrase's anchor. What an automaton finds,
   and nothing else, is an occurrence; words are compared as they are, not by hash.
4. Each occurrence of a passage but the first is removed as a whole.

A block sends equal stretches, windows and anchors once, so a passage that is everywhere costs each
block one entry and no key is hot. A message is a row for (group, part): rows are at most as many as
entries, and parts hold about as much as half a group.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantavol.llm import _text as t
from quantavol.llm._blocks import by_part, spread, squeeze
from quantavol.llm._common import Stage, fresh, need, partitions, tidy

#: Text bytes of a block; a longer document is a block of its own.
BLOCK_BYTES = 3 << 20
#: Blocks of a group, which share messages: so many at most, fewer where groups are fewer than 4 a partition.
GROUP_BLOCKS = 32
#: Phrases of one automaton, which bounds its memory.
AUTOMATON_PHRASES = 25_000
#: The order of a null doc_id among documents: behind the largest long, as its starts are raised.
LAST, RAISED = np.iinfo(np.int64).max, 1 << 62
#: Flags of a window: it recurs; one word comes before, after all occurrences; its first one is here.
RECURS, ONE_BEFORE, ONE_AFTER, FIRST_HERE = 1, 2, 4, 8
MESSAGE = "grp long, part int, body binary"
ADDED = {"kept_text": T.StringType(), "n_words": T.LongType(), "n_removed": T.LongType(), "span_start": T.ArrayType(T.LongType()), "span_end": T.ArrayType(T.LongType())}


def _sliding(values: np.ndarray, n: int, least: np.ufunc) -> np.ndarray:
    """Minima or maxima of all runs of n values, by doubling."""
    out, have = values, 1
    while have * 2 <= n:
        out, have = least(out[:-have], out[have:]), have * 2
    return least(out[: len(out) - (n - have)], out[n - have :]) if n > have else out


def _member(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), dtype=bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


class Windows(NamedTuple):
    """Distinct windows, by ascending hash: first place, whether there are more, and what comes
    before and after all of them (0: nothing, or several words). place, which: all occurrences."""

    key: np.ndarray
    first: np.ndarray
    many: np.ndarray
    before: np.ndarray
    after: np.ndarray
    place: np.ndarray
    which: np.ndarray


class Stretches(NamedTuple):
    """Distinct runs of words whose windows name one anchor, by part; begin, which: all occurrences."""

    first: np.ndarray
    length: np.ndarray
    cut: np.ndarray
    begin: np.ndarray
    which: np.ndarray


class Block:
    """Documents of a block with the hashes that all steps need."""

    def __init__(self, ids: np.ndarray, absent: np.ndarray, column: pa.Array, width: int):
        self.ids, self.absent, self.width = ids, absent.astype(np.int64), width
        self.words = w = t.split_words(column)
        self.h = t.word_hashes(w) if len(w.start) else np.zeros(0, dtype=np.uint64)
        self.place = np.flatnonzero(t.whole_gram_mask(w.first, width))
        self.grams = t.gram_hashes(self.h, width // 2)
        self.reach = width - width // 2 + 1
        self.anchor = _sliding(self.grams, self.reach, np.minimum)[self.place] if len(self.place) else np.zeros(0, dtype=np.uint64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, ascending, and whether they stand in two places of the block or more."""
        if not len(self.anchor):
            return self.anchor, np.zeros(0, dtype=bool)
        # A place counts where its hash is the anchor of one of the windows over it, that is, the largest of theirs.
        over = np.zeros(len(self.grams) + self.reach - 1, dtype=np.uint64)
        over[self.place + self.reach - 1] = self.anchor
        value, count = np.unique(self.grams[_sliding(over, self.reach, np.maximum) == self.grams], return_counts=True)
        return value, count > 1

    def position(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """doc_id and start within the document of places, in the order of documents."""
        doc = np.searchsorted(self.words.first, at, side="right") - 1
        return self.ids[doc], at - self.words.first[doc] + RAISED * self.absent[doc]

    def windows(self, recurring: np.ndarray) -> Windows:
        """The windows with a recurring anchor (ascending); the first is that of smallest position."""
        at = self.place[_member(self.anchor, recurring)]
        key = t.gram_hashes(self.h, self.width)[at] if len(at) else np.zeros(0, dtype=np.uint64)
        doc, start = self.position(at)
        order = np.lexsort((start, doc, key))
        key, at = key[order], at[order]
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=bool)
        begin, which = np.flatnonzero(new), np.cumsum(new) - 1
        owner = np.searchsorted(self.words.first, at, side="right") - 1
        # 32 bits of the neighbours' hashes, never 0; 0 at the edges of documents.
        near = np.concatenate(([0], np.maximum(self.h >> np.uint64(32), np.uint64(1)), [0])).astype(np.uint32)
        sides = []
        for value, edge in ((near[at], at == self.words.first[owner]), (near[at + self.width + 1], at + self.width == self.words.first[owner + 1])):
            value = np.where(edge, np.uint32(0), value)
            sides.append(_one_value(value, begin))
        return Windows(key[begin], at[begin], np.diff(np.concatenate((begin, [len(key)]))) > 1, *sides, at, which)

    def stretches(self, recurring: np.ndarray, parts: int) -> Stretches:
        """Runs of neighbouring windows of one recurring anchor; each goes to its anchor's part."""
        keep = _member(self.anchor, recurring)
        at, anchor = self.place[keep], self.anchor[keep]
        none = np.zeros(0, dtype=np.int64)
        if not len(at):
            return Stretches(none, none, np.zeros(parts + 1, dtype=np.int64), none, none)
        begin = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]))))
        last = np.concatenate((begin[1:], [len(at)])) - 1
        window = t.gram_hashes(self.h, self.width)
        start, stop, part = at[begin], at[last], (anchor[begin] % np.uint64(parts)).astype(np.int64)
        length = stop - start + self.width
        order = np.lexsort((start, length, window[stop], window[start], part))
        s, e, n, p = start[order], stop[order], length[order], part[order]
        new = np.concatenate(([True], (p[1:] != p[:-1]) | (n[1:] != n[:-1]) | (window[s[1:]] != window[s[:-1]]) | (window[e[1:]] != window[e[:-1]])))
        head = np.flatnonzero(new)
        return Stretches(s[head], n[head], np.searchsorted(p[head], np.arange(parts + 1)), s, np.cumsum(new) - 1)


def _one_value(value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The value that all entries of a run have; 0 if they differ."""
    if not len(begin):
        return value[:0]
    low, high = np.minimum.reduceat(value, begin), np.maximum.reduceat(value, begin)
    return np.where(low == high, low, value.dtype.type(0))


def write_blocks(stage: Stage, docs: DataFrame, carry: list[str]) -> DataFrame:
    """Rows (grp, block, body): the documents of a block with the columns to carry; grp: the task, block: a number in it."""
    id_, text_ = fresh(carry, "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids: list[pa.Array] = []
        held_text: list[pa.Array] = []
        held_more: list[pa.RecordBatch] = []
        size, made, source = 0, 0, uuid.uuid4().int >> 65

        def close() -> pa.RecordBatch:
            nonlocal made
            ids, text = pa.concat_arrays(held_ids), pa.concat_arrays(held_text)
            made += 1
            known = ids.fill_null(LAST).to_numpy()
            data, at = t.flat_bytes(text)
            absent = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held_more[0].schema) as stream:
                for more in held_more:
                    stream.write_batch(more)
            others = np.frombuffer(sink.getvalue(), dtype=np.uint8)
            body = squeeze(known.astype("<i8"), at.astype("<i8"), data, absent, others, level=9)
            return pa.RecordBatch.from_arrays([pa.array([source], type=pa.int64()), pa.array([made - 1], type=pa.int32()), pa.array([body], type=pa.binary())], names=["grp", "block", "body"])

        for batch in batches:
            for i, j in t.slices(batch.column(text_), BLOCK_BYTES):
                text = batch.column(text_).slice(i, j - i)
                n = len(t.flat_bytes(text)[0])
                if held_ids and size + n > BLOCK_BYTES:
                    yield close()
                    held_ids, held_text, held_more, size = [], [], [], 0
                held_ids.append(batch.column(id_).slice(i, j - i))
                held_more.append(batch.select(carry).slice(i, j - i))
                held_text.append(text)
                size += n
        if held_ids:
            yield close()
        tidy()

    others = need(docs, *carry).columns
    rows = docs.select(F.col("doc_id").cast("long").alias(id_), F.col("text").cast("string").alias(text_), *(F.col(f"`{c}`") for c in others))
    return stage.table(rows.mapInArrow(run, "grp long, block int, body binary"), "blocks", "snappy")


def _open(body: bytes, width: int) -> tuple[Block, pa.Table]:
    ids, at, data, absent, others = spread(body, "<i8", "<i8", "u1", "u1", "u1")
    text = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])
    return Block(ids, absent, text, width), pa.ipc.open_stream(pa.py_buffer(others)).read_all()


def _blocks(table: pa.Table) -> Iterator[tuple[int, bytes]]:
    """Blocks of a group by number."""
    numbers = table.column("block").to_pylist()
    for i in np.argsort(numbers).tolist():
        yield numbers[i], table.column("body")[i].as_py()


class Outbox:
    """Messages of a group's blocks: one body for each part, with the blocks' entries one after another."""

    def __init__(self, group: int):
        self.group, self.held = group, {}

    def add(self, block: int, part: int, *arrays: np.ndarray) -> None:
        """The first array has an entry for each thing that is answered."""
        self.held.setdefault(part, []).append((block, arrays))

    def rows(self) -> pa.Table:
        bodies = []
        for held in self.held.values():
            numbers = np.array([b for b, _ in held], dtype="<u4")
            counts = np.array([len(a[0]) for _, a in held], dtype="<u4")
            bodies.append(squeeze(numbers, counts, *(np.concatenate(c) for c in zip(*(a for _, a in held)))))
        return _messages([self.group] * len(bodies), list(self.held), bodies)


def _messages(groups: list[int], parts: list[int], bodies: list[bytes]) -> pa.Table:
    return pa.table({"grp": pa.array(groups, type=pa.int64()), "part": pa.array(parts, type=pa.int32()), "body": pa.array(bodies, type=pa.binary())})


def _gather(table: pa.Table, *kinds: str) -> tuple[list[list[np.ndarray]], list[np.ndarray], np.ndarray]:
    """The messages of a part, their arrays one after another, and where each message's entries begin."""
    got = [spread(b, "<u4", "<u4", *kinds) for b in table.column("body").to_pylist()]
    return got, [np.concatenate([g[2 + i] for g in got]) for i in range(len(kinds))], np.concatenate(([0], np.cumsum([len(g[2]) for g in got])))


def _reply(table: pa.Table, got: list[list[np.ndarray]], cut: np.ndarray, answer: np.ndarray) -> pa.Table:
    """A byte for each entry goes back to those that sent it; messages without any answer get none."""
    part, groups, out = table.column("part")[0].as_py(), table.column("grp").to_pylist(), []
    for g, m, a, z in zip(groups, got, cut[:-1], cut[1:]):
        if answer[a:z].any():
            out.append((g, squeeze(m[0], m[1], answer[a:z])))
    return _messages([g for g, _ in out], [part] * len(out), [b for _, b in out])


def _answers(table: pa.Table) -> dict[int, dict[int, np.ndarray]]:
    """Of each block the bytes that each part answered."""
    out: dict[int, dict[int, np.ndarray]] = {}
    for part, body in zip(table.column("part").to_pylist(), table.column("body").to_pylist()):
        numbers, counts, answer = spread(body, "<u4", "<u4", "u1")
        at = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        for b, a, z in zip(numbers.tolist(), at[:-1], at[1:]):
            out.setdefault(b, {})[part] = answer[a:z]
    return out


def _in_order(answers: dict[int, np.ndarray], order: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Answers of all parts in the order of the block's entries."""
    out = np.zeros(len(order), dtype=np.uint8)
    for p, a in answers.items():
        out[order[cut[p] : cut[p + 1]]] = a
    return out


def _recurring(block: Block, answers: dict[int, np.ndarray], parts: int) -> np.ndarray:
    if not answers:
        return np.zeros(0, dtype=np.uint64)
    value, _ = block.anchors()
    return value[_in_order(answers, *by_part(value, parts)) > 0]


def tell_anchors(outbox: Outbox, number: int, block: Block, parts: int) -> None:
    value, many = block.anchors()
    order, cut = by_part(value, parts)
    for p in np.flatnonzero(np.diff(cut)).tolist():
        here = order[cut[p] : cut[p + 1]]
        outbox.add(number, p, value[here], many[here].astype(np.uint8))


def answer_anchors(table: pa.Table) -> pa.Table:
    """For each anchor of a part whether it stands in two places or more."""
    got, (key, many), cut = _gather(table, "<u8", "u1")
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    total = np.add.reduceat(many[order].astype(np.int64) + 1, np.flatnonzero(new))
    twice = np.empty(len(key), dtype=np.uint8)
    twice[order] = (total > 1)[np.cumsum(new) - 1]
    return _reply(table, got, cut, twice)


def tell_windows(outbox: Outbox, number: int, block: Block, w: Windows, parts: int) -> None:
    doc, start = block.position(w.first)
    order, cut = by_part(w.key, parts)
    for p in np.flatnonzero(np.diff(cut)).tolist():
        here = order[cut[p] : cut[p + 1]]
        outbox.add(number, p, w.key[here], doc[here].astype("<i8"), start[here].astype("<i8"), w.many[here].astype(np.uint8), w.before[here], w.after[here])


def answer_windows(table: pa.Table) -> pa.Table:
    """For each window of a part its flags."""
    got, (key, doc, start, many, before, after), cut = _gather(table, "<u8", "<i8", "<i8", "u1", "<u4", "<u4")
    order = np.lexsort((start, doc, key))
    k = key[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    begin, which = np.flatnonzero(new), np.cumsum(new) - 1
    flags = np.where(np.add.reduceat(many[order].astype(np.int64) + 1, begin) > 1, RECURS, 0)
    flags |= np.where(_one_value(before[order], begin) > 0, ONE_BEFORE, 0) | np.where(_one_value(after[order], begin) > 0, ONE_AFTER, 0)
    out = np.empty(len(key), dtype=np.uint8)
    # Of equal first positions (rows that repeat) one is marked.
    out[order] = np.where(flags[which] & RECURS, flags[which] | np.where(new, FIRST_HERE, 0), 0)
    return _reply(table, got, cut, out)


def passages(block: Block, w: Windows, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and lengths of the passages whose first occurrence of all is in this block."""
    at = np.zeros(len(block.h) + 2, dtype=np.uint8)
    at[w.place + 1] = flags[w.which]
    recurs = (at & RECURS) > 0
    # A window goes on with the one before it if both have no other neighbour there.
    follows = np.zeros(len(at), dtype=bool)
    follows[1:] = recurs[1:] & recurs[:-1] & ((at[1:] & ONE_BEFORE) > 0) & ((at[:-1] & ONE_AFTER) > 0)
    chosen = (flags & FIRST_HERE) > 0
    start = np.sort(w.first[chosen]) + 1
    start = start[~follows[start]]
    ends = np.flatnonzero(~follows)
    return start - 1, ends[np.searchsorted(ends, start, side="right")] - start + block.width - 1


def tell_phrases(outbox: Outbox, number: int, block: Block, s: Stretches, place: np.ndarray, length: np.ndarray, parts: int) -> None:
    """To each part its stretches and phrases, and the words in them as they are."""
    if not len(s.first):
        return
    _, index, code = np.unique(block.h, return_index=True, return_inverse=True)
    anchor = block.anchor[np.searchsorted(block.place, place)]
    order, cut = by_part(anchor, parts)
    doc, start = block.position(place)
    raw = block.words.data
    for p in np.flatnonzero(np.diff(s.cut)).tolist():
        a, z = int(s.cut[p]), int(s.cut[p + 1])
        mine = order[cut[p] : cut[p + 1]]
        cells = code[t.ragged(s.first[a:z], s.length[a:z])]
        phrase = code[place[mine][:, None] + np.arange(block.width)].reshape(-1)
        # Each word that occurs once: its bytes behind a length.
        used, back = np.unique(np.concatenate((cells, phrase)), return_inverse=True)
        w = index[used]
        size = block.words.end[w] - block.words.start[w]
        outbox.add(
            number, p, s.length[a:z].astype("<u4"),
            np.array([len(mine), len(used), int(size.sum()), len(cells)], dtype="<u8"), size.astype("<u4"), raw[t.ragged(block.words.start[w], size)], back.astype("<u4"),
            length[mine].astype("<u8"), doc[mine].astype("<i8"), start[mine].astype("<i8"),
        )


class Automaton:
    """Aho-Corasick automaton over words as characters: phrases are rows of equally many word numbers."""

    def __init__(self, phrases: np.ndarray, words: int):
        known = np.unique(phrases)
        # A node's children are searched one by one, so a word is two characters of two alphabets,
        # each of about the root of the number of words; words that no phrase has are number 0.
        self.number = np.zeros(words, dtype=np.int64)
        self.number[known] = np.arange(1, len(known) + 1)
        self.base = int(np.ceil(np.sqrt(len(known) + 1)))
        self.length = phrases.shape[1]
        keys = self._characters(self.number[phrases.reshape(-1)])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, k in enumerate(range(0, len(keys), 2 * self.length)):
            self.automaton.add_word(keys[k : k + 2 * self.length], i)
        self.automaton.make_automaton()

    def _characters(self, number: np.ndarray) -> str:
        # Characters from U+0100 on: clear of surrogates as long as an alphabet has under 50,000.
        if self.base > 25_000:
            raise ValueError("too many words for one automaton")
        pair = np.column_stack((number // self.base, self.base + number % self.base)) + 0x100
        return pair.astype("<u4").tobytes().decode("utf-32-le")

    def locate(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, phrase) of every occurrence in a stream of word numbers (below 0: no word)."""
        text = self._characters(np.where(stream < 0, 0, self.number[stream]))
        hits = np.fromiter((x for hit in self.automaton.iter(text) for x in hit), dtype=np.int64).reshape(-1, 2)
        return hits[:, 0] // 2 - (self.length - 1), hits[:, 1]


def find_phrases(table: pa.Table, width: int) -> pa.Table:
    """Compiles a part's phrases, streams its stretches through the automata, and answers occurrences.

    To each block: stretch, offset in it, length of the passage and position of its first occurrence.
    """
    part, groups = table.column("part")[0].as_py(), table.column("grp").to_pylist()
    got, (lengths, facts, sizes, raw, codes, long_, doc, start), cut = _gather(table, "<u4", "<u8", "<u4", "u1", "<u4", "<u8", "<i8", "<i8")
    facts = facts.astype(np.int64).reshape(-1, 4)
    # Words of all blocks get numbers by their bytes.
    at = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw.tobytes())]).dictionary_encode()
    number, n_words = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
    word_at = np.concatenate(([0], np.cumsum(facts[:, 1])))[:-1]
    in_block = facts[:, 3] + facts[:, 0] * width
    code = number[codes.astype(np.int64) + np.repeat(word_at, in_block)]
    ends = np.cumsum(in_block)
    is_phrase = np.zeros(len(code), dtype=bool)
    is_phrase[t.ragged(ends - facts[:, 0] * width, facts[:, 0] * width)] = True
    phrases, cells = code[is_phrase].reshape(-1, width), code[~is_phrase]
    # One stream of all stretches, with no word between them.
    n = lengths.astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(n + 1)))
    stream = np.full(int(begin[-1]), -1, dtype=np.int64)
    stream[t.ragged(begin[:-1], n)] = cells
    found = []
    for lo in range(0, len(phrases), AUTOMATON_PHRASES):
        place, which = Automaton(phrases[lo : lo + AUTOMATON_PHRASES], n_words).locate(stream)
        found.append((place, which + lo))
    place, which = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    order = np.argsort(place, kind="stable")
    place, which = place[order], which[order]
    stretch = np.searchsorted(begin, place, side="right") - 1
    out = []
    for g, m, a, z in zip(groups, got, cut[:-1], cut[1:]):
        i, j = np.searchsorted(stretch, (a, z))
        if i < j:
            own = np.concatenate(([0], np.cumsum(m[1], dtype=np.int64)))
            block = np.searchsorted(own, stretch[i:j] - a, side="right") - 1
            w = which[i:j]
            columns = [stretch[i:j] - a - own[block], place[i:j] - begin[stretch[i:j]], long_[w], doc[w], start[w]]
            out.append((g, squeeze(m[0], np.bincount(block, minlength=len(m[0])).astype("<u4"), *(c.astype("<i8") for c in columns))))
    tidy()
    return _messages([g for g, _ in out], [part] * len(out), [b for _, b in out])


def _found(table: pa.Table) -> dict[int, list[tuple[int, list[np.ndarray]]]]:
    """Of each block the parts' occurrences."""
    out: dict[int, list[tuple[int, list[np.ndarray]]]] = {}
    for part, body in zip(table.column("part").to_pylist(), table.column("body").to_pylist()):
        numbers, counts, *columns = spread(body, "<u4", "<u4", *["<i8"] * 5)
        at = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        for b, a, z in zip(numbers.tolist(), at[:-1], at[1:]):
            out.setdefault(b, []).append((part, [c[a:z] for c in columns]))
    return out


def covered_words(block: Block, s: Stretches, found: list[tuple[int, list[np.ndarray]]]) -> np.ndarray:
    """Which words of a block belong to an occurrence of a passage that isn't its first."""
    edge = np.zeros(len(block.h) + 1, dtype=np.int64)
    by_stretch = np.searchsorted(s.which, np.arange(len(s.first) + 1))
    for part, (stretch, offset, length, doc, start) in found:
        stretch = stretch + s.cut[part]
        times = by_stretch[stretch + 1] - by_stretch[stretch]
        at = s.begin[t.ragged(by_stretch[stretch], times)] + np.repeat(offset, times)
        own, place = block.position(at)
        gone = (own != np.repeat(doc, times)) | (place != np.repeat(start, times))
        np.add.at(edge, at[gone], 1)
        np.add.at(edge, at[gone] + np.repeat(length, times)[gone], -1)
    return np.cumsum(edge[:-1]) > 0


def _kept_texts(block: Block, gone: np.ndarray, joined: bool) -> list[bytes]:
    """Texts without the words that go: words joined by one space, or as they stood in the text."""
    w = block.words
    raw, out = w.data.tobytes(), []
    keep = ~gone
    for d in range(len(block.ids)):
        a, z = int(w.first[d]), int(w.first[d + 1])
        lo, hi = int(w.doc_at[d]), int(w.doc_at[d + 1])
        if joined:
            if keep[a:z].all():
                out.append(b" ".join(raw[lo:hi].split()))
            else:
                at = np.flatnonzero(keep[a:z]) + a
                out.append(b" ".join([raw[x:y] for x, y in zip(w.start[at].tolist(), w.end[at].tolist())]))
        elif keep[a:z].all():
            out.append(raw[lo:hi])
        else:
            # A removed run goes together with the white space before it.
            pieces, at = [], lo
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone[a:z].astype(np.int8), [0]))))
            for x, y in zip(edges[::2] + a, edges[1::2] + a):
                pieces.append(raw[at : int(w.end[x - 1]) if x > a else lo])
                at = int(w.end[y - 1])
            pieces.append(raw[at:hi])
            out.append(b"".join(pieces).lstrip() if gone[a] else b"".join(pieces))
    return out


def remove_repeats(spark: SparkSession, docs: DataFrame, width: int = 20, joined: bool = False, carry: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The carried columns, kept_text, n_words, n_removed, span_start and span_end of every row.

    A word goes if a window of `width` words that covers it also starts earlier: in a document of
    smaller doc_id, or earlier in the same one. Windows are judged on the input. Spans are word
    numbers of the removed runs, from and to (exclusive). Null texts are empty and stay. doc_id is an
    integer; null ids come last. Rows that repeat a doc_id, or have none, with one text stand at
    one place, so none of them is earlier than the other. joined: kept words joined by one space; else the
    text as it stood, with removed runs and the white space before them cut out. prefix: before
    the names of the added columns, where carried columns have the same. No rows give no rows.
    """
    if width < 2:
        raise ValueError("width must be at least 2")
    added = {prefix + c: k for c, k in ADDED.items()}
    if clash := {c.lower() for c in added} & {c.lower() for c in carry}:
        raise ValueError(f"carried columns have the names of added ones, give a prefix: {', '.join(sorted(clash))}")
    stage = Stage(spark, "phrases")
    blocks = write_blocks(stage, docs, list(carry))
    # Groups are neighbouring blocks of one task. A part holds about as much as half of a largest group.
    n_blocks, p = blocks.count(), partitions(spark)
    parts = max(2 * p, -(-2 * n_blocks // GROUP_BLOCKS))
    blocks = blocks.withColumn("grp", F.xxhash64("grp", F.floor(F.col("block") / min(GROUP_BLOCKS, max(1, -(-n_blocks // (4 * p)))))))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outbox = None
        for batch in batches:
            for group, number, body in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "body"))):
                if outbox is None or outbox.group != group:
                    if outbox is not None:
                        yield from outbox.rows().to_batches()
                    outbox = Outbox(group)
                tell_anchors(outbox, number, _open(body, width)[0], parts)
        if outbox is not None:
            yield from outbox.rows().to_batches()
        tidy()

    def by_kind(table: pa.Table) -> tuple[pa.Table, pa.Table]:
        kinds = table.column("kind")
        return table.filter(pc.equal(kinds, 1)), table.filter(pc.equal(kinds, 2))

    anchors = stage.table(blocks.mapInArrow(tell, MESSAGE).groupBy("part").applyInArrow(answer_anchors, MESSAGE), "anchors", "snappy")

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        outbox, one = Outbox(left.column("grp")[0].as_py()), _answers(right)
        for number, body in _blocks(left):
            if number in one:
                block, _ = _open(body, width)
                tell_windows(outbox, number, block, block.windows(_recurring(block, one[number], parts)), parts)
        tidy()
        return outbox.rows()

    asked = blocks.groupBy("grp").cogroup(anchors.groupBy("grp")).applyInArrow(ask, MESSAGE)
    windows = stage.table(asked.groupBy("part").applyInArrow(answer_windows, MESSAGE), "windows", "snappy")
    told = anchors.withColumn("kind", F.lit(1)).unionByName(windows.withColumn("kind", F.lit(2)))

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        outbox = Outbox(left.column("grp")[0].as_py())
        one, two = (_answers(x) for x in by_kind(right))
        for number, body in _blocks(left):
            if number in one:
                block, _ = _open(body, width)
                recurring = _recurring(block, one[number], parts)
                w = block.windows(recurring)
                flags = _in_order(two.get(number, {}), *by_part(w.key, parts))
                tell_phrases(outbox, number, block, block.stretches(recurring, parts), *passages(block, w, flags), parts)
        tidy()
        return outbox.rows()

    sent = blocks.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(send, MESSAGE)
    hits = stage.table(sent.groupBy("part").applyInArrow(lambda table: find_phrases(table, width), MESSAGE), "occurrences", "snappy")
    last = anchors.withColumn("kind", F.lit(1)).unionByName(hits.withColumn("kind", F.lit(2)))
    schema = T.StructType([*(docs.schema[c] for c in carry), *(T.StructField(c, k) for c, k in added.items())])
    names = schema.names

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        one, found = by_kind(right)
        one, found = _answers(one), _found(found)
        out = []
        for number, body in _blocks(left):
            block, others = _open(body, width)
            gone = np.zeros(len(block.h), dtype=bool)
            if number in found:
                gone = covered_words(block, block.stretches(_recurring(block, one[number], parts), parts), found[number])
            out.append(_result(block, others, _kept_texts(block, gone, joined), gone, names))
        tidy()
        return pa.concat_tables(out)

    return blocks.groupBy("grp").cogroup(last.groupBy("grp")).applyInArrow(finish, schema)


def _result(block: Block, others: pa.Table, texts: list[bytes], gone: np.ndarray, names: list[str]) -> pa.Table:
    first = block.words.first
    total = np.concatenate(([0], np.cumsum(gone)))
    doc = block.words.doc_of()
    before = np.concatenate(([False], gone[:-1])) if len(gone) else gone
    after = np.concatenate((gone[1:], [False])) if len(gone) else gone
    inner = np.zeros(len(gone) + 1, dtype=bool)
    inner[first] = True
    starts = np.flatnonzero(gone & (~before | inner[:-1]))
    ends = np.flatnonzero(gone & (~after | inner[1:]))
    lists = []
    for places, shift in ((starts, 0), (ends, 1)):
        owner = doc[places] if len(places) else np.zeros(0, dtype=np.int64)
        at = np.searchsorted(owner, np.arange(len(first)))
        lists.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(places - first[owner] + shift)))
    removed = total[first[1:]] - total[first[:-1]]
    added = [pa.array(texts, type=pa.binary()).cast(pa.string()), pa.array(block.words.counts), pa.array(removed), *lists]
    return pa.table([*others.columns, *added], names=names)
