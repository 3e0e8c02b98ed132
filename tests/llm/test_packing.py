import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quantavol.llm import packing
from quantavol.llm.queries import tokenizer_path


def check(rows, most):
    """Sequences are gapless from 0, and pieces lie in them without gap or overlap."""
    by = defaultdict(list)
    for seq, offset, length in rows:
        by[seq].append((offset, length))
    assert sorted(by) == list(range(len(by)))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= most
    return len(by)


def worst_fit(lengths, most):
    """The method piece by piece: longest first, each into the shortest pack if it fits there."""
    packs = []
    for length in sorted(lengths, reverse=True):
        if packs and min(packs) + length <= most:
            packs[packs.index(min(packs))] += length
        else:
            packs.append(length)
    return packs


@pytest.mark.parametrize("seed", range(6))
def test_histogram(seed):
    rng = random.Random(seed)
    hist = {rng.randint(1, 64): rng.randint(1, 200) for _ in range(rng.randint(1, 40))}
    rows = [(p.first + k, p.offset, p.length) for p in packing.pack_histogram(hist, 64) for k in range(p.count)]
    n = check(rows, 64)
    assert len(rows) == sum(hist.values())
    assert n == len(set(r[0] for r in rows)) and fills(rows) == sorted(worst_fit([a for a, b in hist.items() for _ in range(b)], 64))
    ranks = defaultdict(list)
    for p in packing.pack_histogram(hist, 64):
        ranks[p.length] += range(p.rank, p.rank + p.count)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in hist.items()}


def fills(rows):
    out = defaultdict(int)
    for sequence, _, length in rows:
        out[sequence] += length
    return sorted(out.values())


def test_shortest_pack_first():
    """Packs that took pieces of a length are as open to the next piece as others."""
    rng = random.Random(7)
    for hist in [{40: 1, 30: 1, 5: 2}, *({rng.randint(1, 64): rng.randint(1, 9) for _ in range(rng.randint(1, 12))} for _ in range(300))]:
        rows = [(p.first + k, p.offset, p.length) for p in packing.pack_histogram(hist, 64) for k in range(p.count)]
        assert fills(rows) == sorted(worst_fit([a for a, b in hist.items() for _ in range(b)], 64)), hist


def test_bad_lengths():
    with pytest.raises(ValueError):
        packing.pack_histogram({65: 1}, 64)
    assert packing.pack_histogram({}) == []


def test_documents(spark, docs, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(spark, docs, tokenizer_path(), 512).collect()
    check([(r["sequence_id"], r["offset"], r["length"]) for r in got], 512)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert set(by) == {r[0] for r in corpus}
    for i, text, *_ in corpus:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)


def test_repeats_nulls_and_special_strings(spark):
    text = "a<|endoftext|>b <|startoftext|> ÄÖ don't x"
    rows = [(None, text), (1, text), (1, text), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(spark, df, tokenizer_path()).collect()
    assert len(got) == 4 and check([(r["sequence_id"], r["offset"], r["length"]) for r in got], 4096) == 1
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert {r["doc_tokens"] for r in got} == {1, len(ids) + 1}
    cut = packing.pieces(df, tokenizer_path(), ids=True).filter("doc_id = 1").first()
    assert cut["ids"] == [*ids, 2]


def test_empty(spark, no_docs):
    assert packing.pack_documents(spark, no_docs, tokenizer_path()).count() == 0
