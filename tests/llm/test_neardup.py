import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from quantavol.llm import neardup
from quantavol.llm._common import Stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width=5):
    w = WORD.findall(lowered(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < width else frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute(rows, percent):
    sets = {i: shingles(x) for i, x in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_equals_brute_force(spark, docs, corpus):
    for percent in (80, 85):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark, docs, percent).collect()}
        assert got == brute([(r[0], r[1]) for r in corpus], percent)


def test_chunks_across(spark):
    """A chain of near copies longer than a chunk keeps every link."""
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[i : i + 60])) for i in range(30)] + [(100 + i, " ".join([f"v{j}" for j in range(50)] + [f"u{i}"])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small = neardup.Forest(chunk=4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark, df, 85, forest=small).collect()}
    assert got == brute(rows, 85)


def test_pairs_of_chunks_of_one_part_are_left_out(spark, monkeypatch):
    """A large part and stragglers that only candidates join: pieces of work grow with the part's size."""
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(120)] + [(200 + i, " ".join([*base[:58], *(f"y{i}{k}" for k in range(22))])) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    moved, confirm = {}, neardup.confirm

    def counted(stage, groups, texts, *more):
        moved[more[-1]] = groups.count()
        return confirm(stage, groups, texts, *more)

    monkeypatch.setattr(neardup, "confirm", counted)
    # Every pair is a candidate; the sketch tells nothing.
    forest = neardup.Forest(trees=24, least=1, slack=2.0, chunk=8)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark, df, 80, forest=forest).collect()}
    assert got == {**{i: 0 for i in range(120)}, **{200 + i: 200 + i for i in range(3)}}
    assert moved.get("across", 0) <= 4 * 123


def test_edges(spark, no_docs):
    assert neardup.near_duplicates(spark, no_docs).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A B C d e f"), (5, None), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark, df).collect()), key=str)
    assert got == sorted([(2, 2, True), (3, 2, False), (3, 2, False), (5, 5, True), (6, 6, True), (None, None, True)], key=str)


def test_long_texts_have_own_prefixes():
    """Minima of very large sets are small numbers; prefixes still tell the sets apart."""
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 1 << 63, 1_600_000, dtype=np.uint64)
    top = neardup.min_hashes(grams, np.array([0, 800_000, 1_600_000]), 12) >> np.uint32(16)
    assert (top[0] != top[1]).all() and len(np.unique(top)) > 20


def crowd(n):
    """(prefix, sketch) of n sets of one region, of which only the first and the last are alike."""
    sketch = np.random.default_rng(2).integers(0, 256, (n, 64), dtype=np.uint8)
    sketch[-1] = sketch[0]
    return np.zeros((n, 6), dtype=">u2"), sketch


def test_crowded_region_is_compared_as_a_whole():
    prefix, sketch = crowd(300)
    n = len(prefix)
    r = neardup._Rows(np.zeros(n, dtype=np.int32), prefix, sketch, np.full(n, 50), np.arange(n))
    roots = neardup.candidate_sets(r, neardup.Forest(region=16), 80).roots()
    assert roots[-1] == 0 and len(np.unique(roots)) == n - 1


def test_region_over_partitions(spark):
    """Copies at the ends of a region that several partitions share meet."""
    _, sketch = crowd(400)
    values = np.zeros((400, 96, 4), dtype=np.uint8)
    values[:, :64, 3] = sketch
    sets = spark.createDataFrame([(i, 50, v.tobytes()) for i, v in enumerate(values)], "node long, n_shingles long, sig binary")
    links = neardup.forest_links(Stage(spark, "test-links"), sets, neardup.Forest(trees=1), 80).collect()
    assert {(r["a"], r["b"]) for r in links} == {(0, 399)}


def test_confirmed_counts():
    a, b = np.arange(10, dtype=np.uint64), np.arange(2, 11, dtype=np.uint64)
    assert list(zip(*neardup.confirmed([a, b], 72))) == [(0, 1)]
    assert list(zip(*neardup.confirmed([a, b], 73))) == []
    grams, at = neardup.shingle_sets(pa.array(["a b c d e f", None, "x y"]))
    assert np.diff(at).tolist() == [2, 0, 1]
    assert defaultdict(int) == {}
