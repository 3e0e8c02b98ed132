import numpy as np
import pytest

from quantavol.operators import codec
from quantavol.options import CONTAINER_SUFFIX, Dims, Mode, QuantOptions
from quantavol.plans import catalogue, reports

N = 301


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A volume of more different tiles than codewords, whose last box has one plane."""
    at = str(tmp_path_factory.mktemp("volume"))
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(3).uniform(-1, 1, (N, 64)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(k % 7 + 1, 100.0 * k) for k in range(70)], "l_linenumber int, l_extendedprice double").write.parquet(f"{at}/lineitem.parquet")
    return at


@pytest.fixture(scope="module")
def samples(spark, folder):
    return np.array([r["data"] for r in catalogue.volume8(spark, folder).orderBy("z").collect()])


def least_errors(spark, folder, samples, tile):
    """Sum of squared distances of all tiles to their nearest codewords; the last sample of an axis fills up."""
    book = codec.train(catalogue.volume8(spark, folder), QuantOptions(Dims(8, 8, N), 8, tile, Mode.GLOBAL))
    box = samples.reshape(N, 8, 8)
    total = 0
    for z in range(0, N - N % tile.z, tile.z):
        for y in range(0, 8, tile.y):
            for x in range(0, 8, tile.x):
                v = box[z : z + tile.z, y : y + tile.y, x : x + tile.x].ravel()
                total += ((np.asarray(book.vectors, dtype=np.int64) - v) ** 2).sum(axis=1).min()
    return int(total)


def test_whole_lossless(spark, folder, samples):
    for name in ("individual_codec_whole", "raw_volume_whole"):
        got = catalogue.queries()[name](spark, folder).orderBy("z", "y", "x").collect()
        assert len(got) == 64 * N and [r["v"] for r in got] == samples.ravel().tolist(), name
    got = {r["z"]: r["big"] for r in catalogue.queries()["i32_bytes_whole"](spark, folder).collect()}
    assert got == {z: (v - 32768).astype(">i4").tobytes().hex().upper() for z, v in enumerate(samples)}
    assert {r["z"]: r["n"] for r in catalogue.queries()["codebook_exists_whole"](spark, folder).collect()} == {z: 10 for z in range(7)}


def test_few_tiles_lose_nothing(spark, folder, samples):
    """Volumes of fewer different boxes than codewords come back unchanged, as layers and as stream boxes."""
    from quantavol.operators import volume
    from quantavol.streaming import chunks as streams

    planes = volume.select_planes(catalogue.volume8(spark, folder), planes=(0, 31))
    options = QuantOptions(Dims(8, 8, 32), 8, Dims(4, 4, 4), Mode.GLOBAL)
    book = codec.train(planes, options)
    back = codec.decompress(codec.compress(planes, options, book), options.dims, options.tile, 256, book)
    assert [r["data"] for r in back.orderBy("z").collect()] == samples[:32].tolist()
    book = codec.train(planes, QuantOptions(Dims(8, 8, 32), 8, Dims(4, 4, 2), Mode.GLOBAL))
    rows = [(i, 8, 8, 4, samples[4 * i : 4 * i + 4].ravel().tolist()) for i in range(8)]
    boxes = spark.createDataFrame(rows, "id long, x int, y int, z int, data array<int>")
    got = streams.decode_boxes(streams.encode_boxes(boxes, Dims(4, 4, 2), book), Dims(4, 4, 2), book).collect()
    assert {r["id"]: r["data"] for r in got} == {r[0]: r[4] for r in rows}


def test_commands(spark, folder, samples):
    got = catalogue.queries()["command_roundtrip"](spark, folder).orderBy("z", "y", "x").collect()
    assert [r["v"] for r in got] == samples.ravel().tolist()
    with pytest.raises(reports.OptionError):
        reports.run_command(spark, ["-cf", "-fn", "nothing", "x.raw", "4x4x1"])


def test_inputs_by_kind(spark, tmp_path):
    """Images bring their dimensions; a container is decoded; all else is a raw volume."""
    page = (np.arange(48).reshape(6, 8) * 7).astype(">u2")
    (tmp_path / "a.pgm").write_bytes(b"P5 8 6 65535\n" + page.tobytes())
    (tmp_path / "v.raw").write_bytes(page.tobytes() * 3)
    for name, dims, depth in (("a.pgm", "1x1x1", 1), ("v.raw", "8x6x3", 3)):
        path = str(tmp_path / name)
        reports.run_command(spark, ["-c", "-vq", "8x6", "-b", "1", "-o", f"{path}.volume{CONTAINER_SUFFIX}", path, dims], lambda x: None)
        o = QuantOptions(Dims(8, 6, depth), path=path)
        assert [r["data"] for r in reports.open_input(spark, o).orderBy("z").collect()] == [page.ravel().tolist()] * depth and o.dims == (8, 6, depth)
        o = QuantOptions(o.dims, path=f"{path}.volume{CONTAINER_SUFFIX}")
        assert [r["data"] for r in reports.open_input(spark, o).orderBy("z").collect()] == [page.ravel().tolist()] * depth


def test_sets_of_planes(spark, tmp_path):
    from quantavol.sources import raw

    assert raw.set_text([5, 1, 2, 3, 9, 9]) == "1-3,5-5,9-9" and raw.planes_text("9,1-3,2", 10) == [1, 2, 3, 9]
    data = np.arange(40, dtype=">u2")
    (tmp_path / "v.raw").write_bytes(data.tobytes())
    got = raw.read(spark, str(tmp_path / "v.raw"), Dims(2, 2, 10), [7, 0, 8]).orderBy("z").collect()
    assert [(r["z"], r["data"][0]) for r in got] == [(0, 0), (7, 28), (8, 32)]
    assert raw.read(spark, str(tmp_path / "v.raw"), Dims(2, 2, 10), []).count() == 0


def test_whole_lossy(spark, folder, samples):
    boxes = catalogue.queries()["stream_boxes_whole"](spark, folder).collect()
    assert {r["id"]: r["n"] for r in boxes} == {i: 64 * min(4, N - 4 * i) for i in range(76)}
    want = least_errors(spark, folder, samples, Dims(4, 4, 2))
    assert want > 0 and sum(r["sq_sum"] for r in boxes if r["id"] < 75) == want
    planes = catalogue.queries()["voxel_codec_whole"](spark, folder).collect()
    want = least_errors(spark, folder, samples, Dims(4, 4, 4))
    assert want > 0 and {r["z"] for r in planes} == set(range(N))
    assert abs(64 * sum(r["mse"] for r in planes if r["z"] < 300) / want - 1) < 1e-6


def test_error_grid_takes_all(spark, folder, monkeypatch):
    seen = []
    monkeypatch.setattr(reports, "error_grid", lambda planes, dims, bits, *a: seen.append((planes.count(), dims, bits)))
    catalogue.queries()["codec_error_grid"](spark, folder)
    assert seen == [(N, Dims(8, 8, N), [2, 3, 4, 5, 6, 7, 8])]
