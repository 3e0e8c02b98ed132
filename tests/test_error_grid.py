"""the grid of round trips."""

import numpy as np

from quantavol.options import Dims, Mode, QuantOptions
from quantavol.plans import reports


def test_grid_equals_round_trips_without_joins(spark):
    """Every cell is what a round trip of its own gives; the plan has no join and reads the planes once a tile."""
    rng, dims = np.random.default_rng(4), Dims(8, 8, 11)
    planes = spark.createDataFrame([(z, d) for z, d in enumerate(rng.integers(0, 65536, (11, 64)).tolist())], "z int, data array<int>").cache()
    tiles, modes, bits = [None, Dims(9), Dims(3, 3), Dims(3, 3, 3)], [Mode.GLOBAL, Mode.INDIVIDUAL, Mode.MIDDLE_PLANE], [2, 3, 5]
    grid = reports.error_grid(planes, dims, bits, tiles, modes)
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("InMemoryRelation") == len(tiles)
    assert grid.dtypes == [("tile", "string"), ("mode", "string"), ("bits", "int"), ("z", "int"), ("abs_sum", "bigint"), ("mae", "double"), ("mse", "double"), ("psnr", "double"), ("n", "bigint")]
    got = grid.collect()
    assert len(got) == 11 * 3 * 10
    for tile in tiles:
        for mode in modes if tile is None or tile.z == 1 else [Mode.GLOBAL]:
            for b in bits if mode is not Mode.MIDDLE_PLANE else [3]:
                want = reports.roundtrip(planes, QuantOptions(dims, b, tile, mode)).collect()
                name = "scalar" if tile is None else str(tile)
                assert sorted(tuple(r)[3:] for r in got if tuple(r)[:3] == (name, mode.value, b)) == sorted(tuple(r) for r in want), (name, mode, b)
