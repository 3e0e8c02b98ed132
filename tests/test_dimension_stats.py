"""Moments of vectors whose products pass 64 bits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantavol.operators import metrics

N = 400_000


@pytest.fixture(scope="module")
def stats(spark):
    """Dimension 2's variance is the largest, by one part in 10^11 and so in no double that has been rounded to a few digits."""
    i = F.col("id")
    most = F.lit(65535)
    half = F.when(i % 2 == 0, 0).otherwise(most)
    vecs = spark.range(N, numPartitions=4).select(F.array((i % 65536), F.when(i == 1, most - 1).otherwise(half), half).cast("array<int>").alias("vec"))
    return metrics.dimension_stats(vecs)


def test_dimension_stats_of_many_vectors(stats):
    """F3"""
    i = np.arange(N, dtype=object)
    for row, v in zip(stats.orderBy("dim").collect(), (i % 65536, np.where(i == 1, 65534, i % 2 * 65535), i % 2 * 65535)):
        exact = N * int((v * v).sum()) - int(v.sum()) ** 2
        assert int(row["deviations"]) == exact > 2**63 and row["variance"] == pytest.approx(exact / N**2, rel=1e-15)
        assert (row["n"], row["min"], row["max"], row["median"]) == (N, v.min(), v.max(), int(np.median(v.astype(np.int64))))


def test_widest_dimension_of_many_vectors(stats):
    """F4"""
    assert metrics.widest_dimension(stats).first()["dim"] == 2
