"""Language identification by rank-order profiles.

A profile is the list of a text's most frequent character n-grams. A document gets the language
whose profile is nearest by out-of-place distance: the sum, over the document's n-grams, of how far
each stands from its rank in the language's profile. (Cavnar and Trenkle, 1994.)
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantavol.llm import _text as t
from quantavol.llm._common import Stage, need

ORDERS = (1, 2, 3)
#: Bits of a code point; three of them and a document's number share 64 bits.
CODE_BITS = 21
#: Characters whose n-grams are counted at once.
AT_ONCE = 1 << 18
#: Profiles are broadcast: so many languages times so many n-grams at most, 8 bytes each.
MOST_LANGUAGES = 1000

_LETTER: np.ndarray | None = None
_FOLD: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter; its lower-case form where that is one character."""
    global _LETTER, _FOLD
    if _LETTER is None:
        every = [chr(c) for c in range(0x110000)]
        _LETTER = np.array([unicodedata.category(c)[0] == "L" for c in every])
        _FOLD = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in every], dtype=np.uint32)
    return _LETTER, _FOLD


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of texts, non-letters as one blank between words; offsets; letters a text.

    Each text is preceded by a blank, so that n-grams mark word starts and ends.
    """
    letter, fold = _tables()
    data, at = t.flat_bytes(column)
    lead = (data & 0xC0) != 0x80
    count = np.concatenate(([0], np.cumsum(lead)))[at]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    if len(points) != count[-1]:
        raise ValueError("text isn't valid UTF-8")
    is_letter = letter[points]
    per = np.concatenate(([0], np.cumsum(is_letter)))
    letters = per[count[1:]] - per[count[:-1]]
    folded = np.where(is_letter, fold[points], 0)
    n = len(count) - 1
    # A blank before each text and after it; runs of blanks count once.
    length = np.diff(count) + 2
    out = np.zeros(int(length.sum()), dtype=np.uint32)
    begin = np.concatenate(([0], np.cumsum(length)))
    out[t.ragged(begin[:-1] + 1, np.diff(count))] = folded
    doc = np.repeat(np.arange(n), length)
    again = np.zeros(len(out), dtype=bool)
    again[1:] = (out[1:] == 0) & (out[:-1] == 0) & (doc[1:] == doc[:-1])
    out, doc = out[~again], doc[~again]
    return out, np.searchsorted(doc, np.arange(n + 1)), letters


def counted(points: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, code, count) of the n-grams within texts, by group and code; a lone blank is none.

    group: a number for each text. Codes hold code points plus one in CODE_BITS each, so they are in
    the order of length and then of points. Characters are numbered within the slice, so that group
    and n-gram fit into one 64-bit key and one sort counts them.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(points):
        return none, none.astype(np.uint64), none
    present = np.zeros(int(points.max()) + 1, dtype=bool)
    present[points] = True
    alphabet = np.flatnonzero(present).astype(np.uint64)
    number = np.cumsum(present).astype(np.uint64)[points]  # from 1
    bits = int(len(alphabet)).bit_length()
    longest = max(ORDERS)
    if bits * longest + int(group.max()).bit_length() > 63:
        # Very many characters or groups: numbers of the distinct n-grams take their place.
        half = np.searchsorted(at, at[-1] // 2)
        if 0 < half < len(at) - 1:
            parts = [counted(points[at[i] : at[j]], at[i : j + 1] - at[i], group[i:j]) for i, j in ((0, half), (half, len(at) - 1))]
            return added(*(np.concatenate(x) for x in zip(*parts)))
        raise ValueError("more different characters and groups than 63 bits hold")
    ends = np.repeat(at[1:], np.diff(at))
    owner = np.repeat(group.astype(np.uint64), np.diff(at)) << np.uint64(bits * longest)
    keys, code = [], np.zeros(len(points), dtype=np.uint64)
    for n in range(1, longest + 1):
        m = len(points) - n + 1
        if m < 1:
            break
        code = (code[:m] << np.uint64(bits)) | number[n - 1 :]
        if n in ORDERS:
            ok = np.arange(n, m + n) <= ends[:m]
            if n == 1:
                ok &= points != 0
            keys.append((owner[:m] | code)[ok])
    key = np.sort(np.concatenate(keys))
    if not len(key):
        return none, none.astype(np.uint64), none
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    key, n = key[first], np.diff(np.concatenate((first, [len(key)])))
    mask, wide = np.uint64((1 << bits) - 1), np.zeros(len(key), dtype=np.uint64)
    for k in range(longest - 1, -1, -1):
        one = (key >> np.uint64(bits * k)) & mask
        char = np.where(one > 0, alphabet[np.maximum(one, np.uint64(1)) - np.uint64(1)] + np.uint64(1), np.uint64(0))
        wide = (wide << np.uint64(CODE_BITS)) | char
    return (key >> np.uint64(bits * longest)).astype(np.int64), wide, n


def added(group: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of counts of equal (group, code), by group and code."""
    order = np.lexsort((code, group))
    group, code, n = group[order], code[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (code[1:] != code[:-1])))) if len(group) else np.zeros(0, dtype=np.int64)
    return group[at], code[at], np.add.reduceat(n, at) if len(at) else n


def by_frequency(group: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The order by group, falling count and the present order, as one sort of packed keys."""
    rest = int(n.max()).bit_length() if len(n) else 1
    place = len(n).bit_length()
    if int(group.max() if len(group) else 0).bit_length() + rest + place > 63:
        return np.lexsort((-n, group))
    key = (group << (rest + place)) | (((1 << rest) - 1 - n) << place) | np.arange(len(n))
    return np.sort(key) & ((1 << place) - 1)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    yield from t.slices(texts, AT_ONCE)


#: Bytes that are no letters, after which a long text may be cut.
CUT = np.array([c < 128 and not chr(c).isalpha() for c in range(256)])


def counted_texts(column: pa.Array, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """counted() of texts, and the letters of each. One long text is taken apart: its characters are
    folded piece by piece, cut after a character that is no letter, and its n-grams counted by
    segments, so that memory follows its characters and its different n-grams."""
    data, at = t.flat_bytes(column)
    if len(column) != 1 or len(data) <= 2 * AT_ONCE:
        points, at, letters = characters(column)
        return *counted(points, at, group), letters
    folded, letters, lo = [], 0, 0
    while lo < len(data):
        hi = min(lo + AT_ONCE, len(data))
        while hi < len(data):
            found = np.flatnonzero(CUT[data[hi - 1 : hi - 1 + AT_ONCE]])
            if len(found):
                hi += int(found[0])
                break
            hi = min(hi + AT_ONCE, len(data))
        piece, _, n = characters(pa.array([data[lo:hi].tobytes().decode("utf-8", "replace")]))
        # A piece ends with the blank that the next one begins with.
        folded.append(piece if not lo else piece[1:])
        letters, lo = letters + int(n[0]), hi
    points, rest = np.concatenate(folded), max(ORDERS) - 1
    del folded
    total = None
    for i in range(0, len(points), AT_ONCE):
        # The n-grams that begin in a segment: those up to the characters behind it, without those in them.
        j, k = min(i + AT_ONCE, len(points)), min(i + AT_ONCE + rest, len(points))
        parts = [counted(points[i:k], np.array([0, k - i]), group)]
        if j < k:
            g, c, n = counted(points[j:k], np.array([0, k - j]), group)
            parts.append((g, c, -n))
        total = added(*(np.concatenate(x) for x in zip(*(parts if total is None else [total, *parts]))))
    g, c, n = total
    some = n > 0
    return g[some], c[some], n[some], np.array([letters])


def profiles(docs: DataFrame, size: int = 400) -> DataFrame:
    """(lang, code, rank) of the most frequent n-grams of each language, ranks from 0.

    Rows with a null lang or text don't count. Equal counts: the smaller code. Counts are summed
    within each batch before they are shuffled, so a language with most of the rows is no hot key;
    of a language's n-grams each task passes on `size` at most (a limit before the shuffle).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            which = langs.indices.to_numpy(zero_copy_only=False)
            kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i, j in _pieces(batch.column("text")):
                kept.append(counted_texts(batch.column("text").slice(i, j - i), which[i:j].astype(np.int64))[:3])
            if kept:
                g, c, n = added(*(np.concatenate(x) for x in zip(*kept)))
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(g)), pa.array(c.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    rows = need(docs, "lang", "text").dropna().mapInArrow(run, "lang string, code long, n long")
    total = rows.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return total.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= size).select("lang", "code", (F.col("rank") - 1).cast("int").alias("rank"))


def predict(docs: DataFrame, profile_rows: list[tuple[str, int, int]], size: int = 400) -> DataFrame:
    """doc_id, lang_pred and score of every document, from the text alone and without a shuffle.

    `und` with score 0 if the text is null or has no letter, or if there is no profile. Equal
    distances: the language first by code point. Score: 1 minus the distance over the largest
    possible one, times the share by which the nearest language leads the next; between 0 and 1.
    """
    langs = sorted({r[0] for r in profile_rows})
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    known = np.array(sorted({r[1] for r in profile_rows}), dtype=np.int64)
    ranks = np.full((len(langs), len(known) + 1), -1, dtype=np.int32)
    if profile_rows:
        ranks[[langs.index(r[0]) for r in profile_rows], np.searchsorted(known, [r[1] for r in profile_rows])] = [r[2] for r in profile_rows]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, "und"], dtype=object)
        for batch in batches:
            for i, j in _pieces(batch.column("text")):
                g, c, n, letters = counted_texts(batch.column("text").slice(i, j - i), np.arange(j - i))
                order = by_frequency(g, n)
                g, c = g[order], c[order]
                first = np.searchsorted(g, np.arange(j - i + 1))
                rank = np.arange(len(g)) - first[g]
                top = rank < size
                g, c, rank = g[top], c[top].view(np.int64), rank[top]
                found = np.minimum(np.searchsorted(known, c), max(len(known) - 1, 0))
                found = np.where(known[found] == c, found, len(known)) if len(known) else np.zeros(len(c), dtype=np.int64)
                distance = np.zeros((len(langs), j - i))
                for k in range(len(langs)):
                    r = ranks[k][found]
                    distance[k] = np.bincount(g, weights=np.where(r < 0, size, np.abs(r - rank)), minlength=j - i)
                pick = np.full(j - i, len(langs))
                score = np.zeros(j - i)
                if langs:
                    best = distance.argmin(axis=0)
                    low = distance.min(axis=0)
                    rest = distance.copy()
                    rest[best, np.arange(j - i)] = np.inf
                    worst = np.maximum(size * np.bincount(g, minlength=j - i), 1)
                    second = np.minimum(rest.min(axis=0), worst) if len(langs) > 1 else worst
                    fit = 1 - np.minimum(low / worst, 1)
                    lead = np.where(second > 0, 1 - low / np.maximum(second, 1e-9), 0)
                    ok = letters > 0
                    pick[ok] = best[ok]
                    score[ok] = np.clip(0.5 * fit + 0.5 * lead, 0, 1)[ok]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(names[pick], type=pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return need(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(docs: DataFrame, folds: int = 3, fold: int = 1):
    """Whether crc32 of doc_id as text leaves this remainder; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify(spark: SparkSession, docs: DataFrame, size: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learns from those not held out."""
    seen = need(docs, "doc_id", "text", "lang").filter(~held_out(docs))
    learnt = Stage(spark, "language").table(profiles(seen, size), "profiles", "snappy")
    # size rows a language, fewer than MOST_LANGUAGES languages.
    rows = [(r["lang"], r["code"], r["rank"]) for r in learnt.limit(size * MOST_LANGUAGES + 1).collect()]
    out = predict(docs, rows, size)
    return out.select("doc_id", held_out(out).alias("held_out"), "lang_pred", "score")
