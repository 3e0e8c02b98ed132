"""Packing token sequences by shortest-pack-first over the length histogram.

Documents are tokenised and cut into pieces of at most the sequence length. The histogram of piece
lengths (at most as many entries as the sequence length) is packed on the driver: lengths are
placed longest first, each into the shortest packs that are open, updating the counts of packing
patterns instead of single packs. Pieces then find their place by their rank among pieces of their
length. (Krell et al., 2021.)
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantavol.llm import _text as t
from quantavol.llm._common import Stage, dense_rank, need, tidy

LENGTH = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker keeps; then it starts anew.
KEPT_WORDS = 1_000_000


class Placement(NamedTuple):
    """Pieces `rank` .. `rank + count - 1` of a length stand at `offset` of sequences `first` onwards."""

    length: int
    rank: int
    count: int
    first: int
    offset: int


def pack_histogram(histogram: dict[int, int], most: int = LENGTH) -> list[Placement]:
    """Placements of all pieces; sequence numbers are gapless from 0.

    Every piece goes to the shortest open pack, one that took pieces of this length like any other; a new
    pack is opened where not even the shortest has room. Open packs are kept as groups of equal fill
    with an interval of sequence numbers. A group of more packs than pieces is split, so the work
    depends on the number of lengths and fills, not of pieces.
    """
    open_packs: list[tuple[int, int, int]] = []  # (fill, first sequence, count), shortest first
    out: list[Placement] = []
    fresh = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= most:
            raise ValueError("a piece must have 1 to `most` tokens")
        while left and open_packs and open_packs[0][0] + length <= most:
            fill, first, count = heapq.heappop(open_packs)
            use = min(count, left)
            out.append(Placement(length, rank, use, first, fill))
            if use < count:
                heapq.heappush(open_packs, (fill, first + use, count - use))
            if fill + length < most:
                heapq.heappush(open_packs, (fill + length, first, use))
            left, rank = left - use, rank + use
        if left:
            # New packs; where several pieces of this length fit into one, they share it.
            each = max(1, most // length)
            full, rest = divmod(left, each)
            for take, packs in ((each, full), (rest, 1 if rest else 0)):
                if not packs:
                    continue
                for k in range(take):
                    out.append(Placement(length, rank, packs, fresh, k * length))
                    rank += packs
                if take * length < most:
                    heapq.heappush(open_packs, (take * length, fresh, packs))
                fresh += packs
    return out


class WordEncoder:
    """Ids of texts from ids of their words, each word encoded once.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of
    its space-separated words one after another. Words go to the tokenizer some thousand at a time,
    held apart by a special token, which it never joins with its neighbours.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = sorted((t_ for t_ in self.tokenizer.get_added_tokens_decoder().items() if t_[1].special), key=lambda x: x[0])
        self.mark_id, self.mark = special[0][0], special[0][1].content
        self.specials = [x.content for _, x in special]
        if not all(x.startswith("<") for x in self.specials):
            raise ValueError("special tokens are taken to start with <")
        self.reset()

    def reset(self) -> None:
        self.key = np.zeros(0, dtype=np.uint64)
        self.begin, self.length = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def ids_of_words(self, words: list[str], marked: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many each has. marked: whether words may hold special tokens' strings."""
        odd = [i for i, w in enumerate(words) if "<" in w and any(s in w for s in self.specials)] if marked else []
        own = {i: self.tokenizer.encode(words[i], add_special_tokens=False).ids for i in odd}
        plain = [w if i not in own else "" for i, w in enumerate(words)] if own else words
        joined = [self.mark.join(plain[i : i + 2048]) for i in range(0, len(plain), 2048)]
        flat, lengths = [], []
        for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(e.ids, dtype=np.uint32)
            marks = np.flatnonzero(ids == self.mark_id)
            lengths.append(np.diff(np.concatenate(([-1], marks, [len(ids)]))) - 1)
            flat.append(ids[ids != self.mark_id])
        ids, n = np.concatenate(flat), np.concatenate(lengths)
        if own:
            at = np.concatenate(([0], np.cumsum(n)))
            pieces = [np.array(own[i], dtype=np.uint32) if i in own else ids[at[i] : at[i + 1]] for i in range(len(words))]
            ids, n = np.concatenate(pieces), np.array([len(p) for p in pieces], dtype=np.int64)
        return ids, n

    def learn(self, keys: np.ndarray, words: list[str], marked: bool = True) -> None:
        """Adds words; keys: their hashes, ascending, none of them known."""
        ids, n = self.ids_of_words(words, marked)
        if self.used + len(ids) > len(self.ids):
            grown = np.zeros(2 * (self.used + len(ids)), dtype=np.uint32)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.key, keys)
        self.key = np.insert(self.key, at, keys)
        self.begin = np.insert(self.begin, at, self.used + np.cumsum(n) - n)
        self.length = np.insert(self.length, at, n)
        self.used += len(ids)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts, and offsets of the texts."""
        w = t.split_words(column)
        if not len(w.start):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(w.doc_at), dtype=np.int64)
        h = t.word_hashes(w)
        if len(self.key) > KEPT_WORDS:
            self.reset()
        # Look-ups in ascending order, each word of the slice once.
        order = np.argsort(h)
        ascending = h[order]
        head = np.concatenate(([True], ascending[1:] != ascending[:-1]))
        distinct, index = ascending[head], order[head]
        found = np.searchsorted(self.key, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = found < len(self.key)
        new[inside] = self.key[found[inside]] != distinct[inside]
        if new.any():
            raw, at = w.data.tobytes(), index[new]
            self.learn(distinct[new], [raw[a:b].decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist())], b"<" in raw)
            found = np.searchsorted(self.key, distinct)
        where = np.empty(len(h), dtype=np.int64)
        where[order] = found[np.cumsum(head) - 1]
        lengths = self.length[where]
        ids = self.ids[t.ragged(self.begin[where], lengths)]
        return ids, np.concatenate(([0], np.cumsum(lengths)))[w.first]


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str, end_id: int = END_ID, most: int = LENGTH, ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, and ids if asked for.

    A null or empty text is the end id alone. Texts are cut every `most` ids, the last piece is
    what is left. One read of the text, no shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_encoder(path)
        for batch in batches:
            for i, j in t.slices(batch.column("text")):
                flat, at = coder.encode(batch.column("text").slice(i, j - i))
                n = np.diff(at) + 1
                with_end = np.full(int(n.sum()), end_id, dtype="<u4")
                begin = np.concatenate(([0], np.cumsum(n)))
                with_end[t.ragged(begin[:-1], n - 1)] = flat
                cuts = -(-n // most)
                doc = np.repeat(np.arange(j - i), cuts)
                start = t.ragged(np.zeros(j - i, dtype=np.int64), cuts) * most
                length = np.minimum(most, n[doc] - start)
                a = begin[doc] + start
                raw = memoryview(with_end).cast("B")
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), (a + length).tolist())]
                columns = [batch.column("doc_id").slice(i, j - i).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, type=pa.int64()), pa.array(n[doc])]
                if ids:
                    at32 = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(at32), pa.array(with_end.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] * ids)])
            tidy()

    return need(docs, "doc_id", "text").mapInArrow(run, schema)


def place(length: str, rank: str, placements: list[Placement]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas: adds sequence_id and offset by binary search in the placements."""
    p = np.array(sorted(placements), dtype=np.int64).reshape(-1, 5)
    key = (p[:, 0] << 44) + p[:, 1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            r = f[rank].to_numpy()
            k = np.searchsorted(key, (f[length].to_numpy() << 44) + r, side="right") - 1
            yield f.drop(columns=rank).assign(sequence_id=p[k, 3] + r - p[k, 1], offset=p[k, 4])

    return run


def pack(spark: SparkSession, cut: DataFrame, most: int = LENGTH) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, start and length; equal rows get places of their own.

    What the driver holds is the histogram of lengths and the placements: bounded by `most`, not by rows.
    """
    stage = Stage(spark, "packing")
    rows = stage.table(cut, "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placements = pack_histogram(histogram, most)
    ranked = dense_rank(stage, rows, ["length"], ["doc_id", "start"], "_rank", "ranked")
    names = [c for c in ranked.columns if c != "_rank"]
    fields = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names)
    return ranked.select(*names, "_rank").mapInPandas(place("length", "_rank", placements), f"{fields}, sequence_id long, offset long")


def pack_documents(spark: SparkSession, docs: DataFrame, path: str, most: int = LENGTH) -> DataFrame:
    """Packs every document into sequences of `most` tokens; a row for each piece.

    Documents longer than a sequence fill whole sequences and leave one shorter piece; all others
    stay whole. Null doc_ids are documents like any other.
    """
    out = pack(spark, pieces(docs, path, END_ID, most), most)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
