import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from quantavol.llm import mixing, sharding
from quantavol.llm._common import n_words


def slow_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * sharding.MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64)
    for n in (1, 8, 9, 100):
        assert sharding.jump(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]
    a, b = sharding.jump(keys, 8), sharding.jump(keys, 9)
    assert set(b[a != b]) == {8} and 0.08 < (a != b).mean() < 0.14
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def test_documents(spark, docs, corpus, no_docs):
    rows = sharding.place_documents(spark, docs).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(i, len((x or "").encode()) + 1, zlib.crc32((x or "").encode())) for i, x, *_ in corpus}
    for s in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 8) and r["law"] == "key" for r in rows)
    assert sharding.place_documents(spark, no_docs).count() == 0
    same = spark.createDataFrame([(7, "x")] * 40 + [(None, None)] * 3, "doc_id long, text string")
    got = sharding.place_documents(spark, same).collect()
    assert sorted(r["slot"] for r in got if r["doc_id"] == 7)[-1] >= 39 and len({(r["shard"], r["slot"]) for r in got}) == 43


def test_targets():
    assert mixing.capped_targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = mixing.capped_targets([10, 200, 0, 50], [5, 2, 1, 5])
    assert got[0] == 30 and got[2] == 0 and got[3] == 150 and sum(got) == pytest.approx(260)
    assert mixing.capped_targets([0, 0], [1, 1]) == [0, 0]


def test_route():
    # The second source can only come from the shared pattern, so the first one leaves it that.
    flow = mixing.route({(0,): 50, (0, 1): 50}, [50, 50])
    assert flow == {((0,), 0): 50, ((0, 1), 1): 50}
    # Repeating is put off until nothing fresh is left, and never goes beyond the limit.
    flow = mixing.route({(0,): 10, (0, 1): 10}, [25, 30])
    assert sum(x for (p, _), x in flow.items() if p == (0,)) == 25 and sum(x for (p, _), x in flow.items() if p == (0, 1)) == 30
    assert sum(mixing.route({(0,): 10}, [100]).values()) == 30
    assert mixing.route({(0,): 0}, [0]) == {}


def test_documents_mix(spark, docs, corpus, no_docs):
    rows = mixing.mix_documents(spark, docs).collect()
    again = mixing.mix_documents(spark, docs.repartition(7)).collect()
    assert sorted(rows, key=lambda r: r["doc_id"]) == sorted(again, key=lambda r: r["doc_id"])
    source = {r[0]: r[3] for r in corpus}
    sizes = {r["doc_id"]: r["size"] for r in rows}
    assert sizes[120] == 0 and sizes[128] == 40
    names = sorted({s for s in source.values() if s}) + [None]
    total = {s: sum(sizes[i] for i in sizes if source[i] == s) for s in names}
    want = dict(zip(names, mixing.capped_targets([total[s] for s in names], [5, 2, 1, 5])))
    for s in names:
        mine = [r for r in rows if source[r["doc_id"]] == s]
        assert all(r["source_size"] == total[s] and r["target"] == pytest.approx(want[s]) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(60, 0.05 * want[s])
    assert all(r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix_documents(spark, no_docs).count() == 0


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate([["a"]] * 20 + [["a", "b"]] * 20 + [["b", "a"]] * 5 + [[]] * 5 + [None] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    got = mixing.mix(spark, df, n_words(F.col("text")), F.col("sources"), weights=(1, 3)).collect()
    assert len(got) == 52 and all(0 <= r["_copies"] <= 3 for r in got)
    shared = [r for r in got if r["_pattern"] == ["a", "b"]]
    assert len(shared) == 25 and sum(r["_copies"] for r in shared) >= 25
