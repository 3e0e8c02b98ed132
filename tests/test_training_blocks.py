"""Training on distributed blocks gives what training on the driver gives."""

import numpy as np
import pytest

from quantavol.operators import vector
from quantavol.options import Dims


@pytest.fixture(scope="module")
def vecs(spark):
    v = np.random.default_rng(8).integers(0, 65536, (3000, 4))
    return spark.createDataFrame([(0, i, x) for i, x in enumerate(v.tolist() + v[:500].tolist())], "z int, vec_ix long, vec array<int>").repartition(40)


def same_sums(a, b):
    return all((x == y).all() for i, (x, y) in enumerate(zip(a, b)) if i not in (1, 2)) and np.allclose(a.dist, b.dist) and np.allclose(a.sq, b.sq)


def test_sums_over_few_tasks(spark, vecs, monkeypatch):
    """a pass has about as many tasks as the set has blocks, and its sums are those of one pass over all."""
    monkeypatch.setattr(vector, "BLOCK_SAMPLES", 1000)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        far, near = vector.TrainingSet(vecs, 4, 3, local_samples=0), vector.TrainingSet(vecs, 4, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    words = np.random.default_rng(9).integers(0, 65536, (20, 4))
    assert far.distinct == near.distinct == 3000 and far.local is None and near.blocks is None
    assert far.parts == 12
    want = near.sums(words)
    assert same_sums(far.sums(words), want) and want.n.sum() == 3500
    monkeypatch.setattr(vector, "MOST_PARTS", 1)
    monkeypatch.setattr(vector, "ADDERS", 3)
    assert same_sums(far.sums(words), want)
    far.close()
    near.close()


def test_all_sizes_from_blocks(vecs):
    near = vector.train_all_sizes(vecs, Dims(4), 16)
    out = {}
    vector.train(vecs, 16, Dims(4), found=lambda b: out.update({len(b.vectors): b}), local_samples=0)
    assert [len(b.vectors) for b in near] == sorted(out) and all((b.vectors == out[len(b.vectors)].vectors).all() for b in near)
