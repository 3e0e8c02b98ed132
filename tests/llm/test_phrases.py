import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quantavol.llm import phrases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    seen, gone, texts = set(), {}, {i: WORD.findall(x or "") for i, x in rows}
    for i in sorted(texts):
        w, hit = texts[i], [False] * len(texts[i])
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            if g in seen:
                hit[k : k + width] = [True] * width
            seen.add(g)
        gone[i] = hit
    return {i: (len(w), sum(gone[i]), " ".join(x for x, g in zip(w, gone[i]) if not g)) for i, w in texts.items()}


def test_equals_brute_force(spark, docs, corpus, monkeypatch):
    for width, most in ((20, 4 << 20), (5, 3000)):
        monkeypatch.setattr(phrases, "BLOCK_BYTES", most)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in phrases.remove_repeats(spark, docs, width, joined=True).collect()}
        assert got == brute([(r[0], r[1]) for r in corpus], width)


def test_kept_text_and_spans(spark):
    rows = [(1, "a b c d e"), (2, "x  a b c d\ty\nz"), (3, None), (None, "a b c d")]
    got = {r["doc_id"]: r for r in phrases.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got[1]["kept_text"] == "a b c d e" and got[2]["kept_text"] == "x\ty\nz" and got[3]["kept_text"] == "" and got[None]["kept_text"] == ""
    assert (got[2]["span_start"], got[2]["span_end"], got[2]["n_removed"]) == ([1], [5], 4)
    assert hashlib.sha256(got[None]["kept_text"].encode()).hexdigest().startswith("e3b0c442")


def test_empty(spark, no_docs):
    assert phrases.remove_repeats(spark, no_docs).count() == 0


def test_repeated_rows_in_one_block_and_across(spark, monkeypatch):
    """A doc_id with one text stands at one place; with other texts, the smallest start is first."""
    w = " ".join(f"w{i}" for i in range(8))
    rows = [(3, w + " a"), (3, w + " a"), (5, "x y " + w), (5, "x y " + w), (None, w + " n"), (None, w + " n"), (7, "p q r s t u v"), (7, "k p q r s t u v"), (None, "n1 n2 n3 n4"), (None, "n1 n2 n3 n4")]
    want = sorted([(3, 0), (3, 0), (5, 8), (5, 8), (None, 8), (None, 8), (7, 0), (7, 7), (None, 0), (None, 0)], key=str)
    for order in (rows, rows[::-1]):
        for most in (4 << 20, 10):
            monkeypatch.setattr(phrases, "BLOCK_BYTES", most)
            df = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
            got = sorted(((r["doc_id"], r["n_removed"]) for r in phrases.remove_repeats(spark, df, 4).collect()), key=str)
            assert got == want, most


def test_nothing_is_found_without_automata(spark, docs, corpus, monkeypatch):
    """Results come from the automata alone."""
    table = pa.table({"grp": pa.array([4]), "part": pa.array([0], type=pa.int32()), "body": pa.array([message(["a b c", "x a b c d", "c a b"], "a b c")], type=pa.binary())})
    (body,) = phrases.find_phrases(table, 3).column("body").to_pylist()
    blocks, counts, stretch, offset, length, doc, start = phrases.spread(body, "<u4", "<u4", *["<i8"] * 5)
    assert (blocks.tolist(), counts.tolist(), stretch.tolist(), offset.tolist(), length.tolist(), doc.tolist(), start.tolist()) == ([2], [2], [0, 1], [0, 1], [3, 3], [7, 7], [5, 5])
    monkeypatch.setattr(phrases.Automaton, "locate", lambda self, stream: (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))
    assert not phrases.find_phrases(table, 3).num_rows


def message(stretches, phrase):
    """The message of block 2 with stretches and one phrase of document 7 at word 5."""
    words = sorted({w for s in stretches for w in s.split()})
    code = [words.index(w) for s in (*stretches, phrase) for w in s.split()]
    n, cells = [len(s.split()) for s in stretches], len(code) - len(phrase.split())
    raw = "".join(words).encode()
    return phrases.squeeze(
        *(np.array(x, dtype=k) for x, k in (([2], "<u4"), ([len(stretches)], "<u4"), (n, "<u4"), ([1, len(words), len(raw), cells], "<u8"), ([len(w) for w in words], "<u4"))),
        np.frombuffer(raw, dtype="u1"), *(np.array(x, dtype=k) for x, k in ((code, "<u4"), ([len(phrase.split())], "<u8"), ([7], "<i8"), ([5], "<i8"))),
    )


def test_passages_are_whole():
    """Windows that always follow each other are one passage, held where it stands first."""
    w = [f"w{i}" for i in range(12)]
    texts = ["x " + " ".join(w) + " y", " ".join(w) + " z", "q " + " ".join(w[:6])]
    block = phrases.Block(np.array([3, 1, 2]), np.zeros(3, dtype=np.uint8), pa.array(texts), 4)
    value, many = block.anchors()
    windows = block.windows(value[many])
    doc, start = block.position(windows.first)
    flags = np.where(windows.many, phrases.RECURS | phrases.FIRST_HERE, 0) | np.where(windows.before > 0, phrases.ONE_BEFORE, 0) | np.where(windows.after > 0, phrases.ONE_AFTER, 0)
    place, length = phrases.passages(block, windows, flags)
    doc, start = block.position(place)
    # The words that all three share, and what only two of them go on with.
    assert sorted(zip(doc.tolist(), start.tolist(), length.tolist())) == [(1, 0, 6), (1, 3, 9)]


def test_messages_grow_with_blocks(spark, monkeypatch):
    """Twice the blocks are at most about twice the messages."""
    rng, sent = random.Random(3), []
    rows = [(i, " ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(30)) + " " + "one passage of words that stands in all of them and more " * 2) for i in range(400)]
    answer = phrases.Stage.table

    def table(self, df, name, *more):
        out = answer(self, df, name, *more)
        sent[-1] += out.count() if name != "blocks" else 0
        return out

    monkeypatch.setattr(phrases.Stage, "table", table)
    for most in (1200, 600):
        monkeypatch.setattr(phrases, "BLOCK_BYTES", most)
        sent.append(0)
        phrases.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).count()
    assert 0 < sent[1] <= 2.2 * sent[0]


def test_clashing_names(spark):
    rows = [(1, "a b c d", "n"), (2, "a b c d", None)]
    for name in ("n_words", "N_removed", "kept_text", "_text", "id", "text_", "grp", "body", "block"):
        df = spark.createDataFrame(rows, f"doc_id long, text string, {name} string")
        got = phrases.remove_repeats(spark, df, 3, carry=("doc_id", name), prefix="_p_").orderBy("doc_id").collect()
        assert [(r[0], r[1], r[2], r[4]) for r in got] == [(1, "n", "a b c d", 0), (2, None, "", 4)]
    with pytest.raises(ValueError):
        phrases.remove_repeats(spark, df.withColumn("N_words", df["doc_id"]), 3, carry=("N_words",))


def test_largest_id_and_no_id(spark):
    rows = [(None, "a b c d"), (2**63 - 1, "a b c d")]
    got = {r[0]: r["n_removed"] for r in phrases.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {None: 4, 2**63 - 1: 0}
