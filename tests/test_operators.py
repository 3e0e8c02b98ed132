import math
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quantavol.functions import arrays
from quantavol.operators import codec, kdtree, metrics, scalar, tiling, vector, volume
from quantavol.operators.huffman import HuffmanCode
from quantavol.options import CONTAINER_SUFFIX, Dims, Mode, QuantOptions, Wrap
from quantavol.plans import reports
from quantavol.sources import codebooks, container, memory, raw


def planes_of(spark, a):
    return memory.from_plane_buffers(spark, list(a))


def data_of(df):
    return np.array([r["data"] for r in df.orderBy("z").collect()])


def test_row_tiles():
    row = np.array([10, 20, 30, 40])
    cases = {Wrap.MIRROR: [10, 20, 30, 40, 40, 30], Wrap.CLAMP: [10, 20, 30, 40, 40, 40], Wrap.BLANK: [10, 20, 30, 40, 0, 0]}
    for wrap, want in cases.items():
        assert tiling.gather(row, Dims(4), Dims(3), wrap).reshape(-1).tolist() == want


def test_block_tiles_and_back():
    got = tiling.gather(np.arange(1, 9), Dims(4, 2), Dims(3, 3))
    assert got.tolist() == [[1, 2, 3, 5, 6, 7, 5, 6, 7], [4, 4, 3, 8, 8, 7, 8, 8, 7]]
    assert tiling.scatter(got, Dims(4, 2), Dims(3, 3)).tolist() == list(range(1, 9))
    assert tiling.scatter(np.array([[1, 2, 3, 4, 5, 6]]), Dims(3, 2), Dims(3, 2)).tolist() == [1, 2, 3, 4, 5, 6]


@settings(max_examples=60, deadline=None)
@given(st.tuples(*[st.integers(1, 7)] * 3), st.tuples(*[st.integers(1, 4)] * 3), st.sampled_from(list(Wrap)))
def test_untile_inverts_tile(dims, tile, wrap):
    dims, tile = Dims(*dims), Dims(*tile)
    box = np.arange(dims.count)
    assert (tiling.scatter(tiling.gather(box, dims, tile, wrap), dims, tile) == box).all()


def test_layers():
    assert [tiling.layer_count(z, 3) for z in (8, 500, 2)] == [2, 166, 1]
    assert [tiling.layer_depth(i, 8, 3) for i in (0, 1)] == [3, 5] and tiling.layer_depth(165, 500, 3) == 5


def test_lloyd_max():
    a = np.bincount([0, 0, 0, 1, 1, 5, 6, 6, 20, 21, 22, 22, 100, 101, 140, 140])
    run = scalar.LloydMax(a, 4)
    assert run.centroids.tolist() == [17, 52, 87, 122]
    run.move_edges()
    assert run.edges.tolist() == [0, 34, 69, 104, 140]
    run.start_at_modes()
    assert run.centroids.tolist() == [0, 52, 100, 140]
    got = scalar.train_counts(a, 4)
    assert got.codebook.centroids.tolist() == [8, 52, 100, 140] and got.boundaries.tolist() == [0, 30, 76, 120, 140]
    assert got.codebook.frequencies.tolist() == [12, 0, 2, 2] and [m for _, m, _ in got.log] == [119.3125, 63.3125, 63.3125]
    b = np.concatenate((np.zeros(1000, dtype=int), a))
    far = scalar.train_counts(b, 4, "reference")
    assert far.codebook.centroids.tolist() == [17, 52, 87, 1036] and far.codebook.frequencies.tolist() == [0, 0, 0, 16] and far.log[-1][1] == 2495.3125
    near = scalar.train_counts(b, 4)
    assert near.codebook.centroids.tolist() == [1008, 1052, 1100, 1140] and near.log[-1][1] == 63.3125


def test_scalar_encode():
    book = scalar.ScalarCodebook(np.array([10, 21, 40, 100]), np.ones(4, dtype=int))
    v = np.array([15, 16, 30, 31, 70, 71])
    assert book.boundaries.tolist() == [15, 30, 70] and book.encode(v).tolist() == [0, 1, 1, 2, 2, 3]


def test_scalar_forms_agree(spark):
    rng = np.random.default_rng(3)
    planes = planes_of(spark, rng.integers(0, 65536, (3, 40)).astype(np.int32))
    book = scalar.train(planes, 8).codebook
    px = volume.pixels(planes, Dims(8, 5))
    by_join = scalar.encode_by_join(px, book.frame(spark))
    by_column = by_join.withColumn("c", scalar.encode_column(F.col("v"), book.boundaries.tolist()))
    assert by_column.filter("c != ix").count() == 0 and by_join.count() == 120
    by_plane = volume.pixels(scalar.encode_planes(planes, book), Dims(8, 5)).withColumnRenamed("v", "w")
    assert by_join.join(by_plane, ["z", "y", "x"]).filter("w != ix").count() == 0
    each = scalar.train_each(planes, 4)
    for z, data in enumerate(data_of(planes)):
        want = scalar.train_counts(np.bincount(data, minlength=65536), 4).codebook
        assert [r["centroid"] for r in each.filter(F.col("z") == z).orderBy("ix").collect()] == want.centroids.tolist()


def test_nearest_ties_and_brute_force():
    assert vector.nearest(np.array([[1, 1]]), np.array([[0, 0], [2, 2]]))[0].tolist() == [0]
    rng = np.random.default_rng(4)
    v, c = rng.integers(0, 65536, (50, 9)), rng.integers(0, 65536, (16, 9))
    d = ((v[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    ix, d2 = vector.nearest(v, c)
    assert (ix == d.argmin(axis=1)).all() and (d2 == d.min(axis=1)).all()


def test_kdtree():
    rng = np.random.default_rng(8)
    words, queries = rng.integers(0, 100, (64, 6)), rng.integers(0, 100, (80, 6))
    words[5] = words[40]
    tree = kdtree.build(words, 4)
    ix, d2 = vector.nearest(queries, words)
    assert [kdtree.lookup(tree, words, q) for q in queries] == list(zip(ix.tolist(), d2.astype(int).tolist()))
    few = [kdtree.lookup(tree, words, q, 2) for q in queries]
    assert all(d >= e for (_, d), e in zip(few, d2)) and sum(i == j for (i, _), j in zip(few, ix)) > 30
    assert isinstance(kdtree.build(np.ones((20, 3), dtype=int), 4), np.ndarray)


def test_few_vectors_and_split(spark):
    vecs = spark.createDataFrame([(0, 0, [1, 2]), (0, 1, [3, 4]), (0, 2, [1, 2])], "z int, vec_ix long, vec array<int>")
    got = vector.train(vecs, 4, Dims(2))
    assert got.codebook.vectors.tolist() == [[1, 2], [3, 4], [0, 0], [0, 0]] and got.codebook.frequencies.tolist() == [2, 1, 0, 0] and got.mse == 0
    v = np.array([[0, 0], [10, 0], [0, 4], [11, 5]])
    one = vector.sums_of(v, np.ones(4), np.zeros((1, 2), dtype=int), 1)
    assert one.centroids.tolist() == [[5, 2]] and one.spread.tolist() == [[2.75, 1.25]]
    assert vector.split(one.centroids, one, np.random.default_rng(0)).tolist() == [[7, 3], [2, 0]]


def test_lbg_local_and_distributed_agree(spark):
    rng = np.random.default_rng(5)
    rows = [(0, i, [int(x) for x in v]) for i, v in enumerate(rng.integers(0, 2000, (120, 4)))]
    vecs = spark.createDataFrame(rows, "z int, vec_ix long, vec array<int>").repartition(3)
    a, b = vector.train(vecs, 8, Dims(4)), vector.train(vecs, 8, Dims(4), local_samples=0)
    assert a.codebook.vectors.tolist() == b.codebook.vectors.tolist() and a.codebook.frequencies.sum() == 120
    assert a.mse < vector.train(vecs, 2, Dims(4)).mse
    assert [len(x.vectors) for x in vector.train_all_sizes(vecs, Dims(4), 16)] == [2, 4, 8, 16]


def test_metrics(spark):
    a, b = planes_of(spark, np.array([[10, 20, 30, 40]])), planes_of(spark, np.array([[11, 20, 28, 44]]))
    e = metrics.plane_errors(a, b).first()
    assert (e["mse"], e["mae"], e["abs_sum"]) == (5.25, 1.75, 7) and e["psnr"] == pytest.approx(89.1279, abs=1e-4)
    assert math.isinf(metrics.plane_errors(a, a).first()["psnr"])
    h = metrics.plane_histogram(planes_of(spark, np.array([[1, 1, 1, 1, 2, 2, 3, 4]])))
    assert metrics.entropy(h, "z").first()["entropy"] == pytest.approx(1.75)


@pytest.mark.parametrize("tile,mode", [*product([None, Dims(3), Dims(3, 3), Dims(5, 3)], [Mode.GLOBAL, Mode.INDIVIDUAL, Mode.MIDDLE_PLANE]), (Dims(3, 3, 3), Mode.GLOBAL)])
def test_codec_equals_quantizing(spark, tmp_path, tile, mode):
    rng = np.random.default_rng(6)
    volume_ = (rng.integers(0, 40, (7, 30)) * 100).astype(np.int32)
    planes, dims = planes_of(spark, volume_), Dims(6, 5, 7)
    o = QuantOptions(dims, 3, tile, mode)
    book = reports.shared_book(planes, o)
    path = str(tmp_path / "v.volume")
    head = container.Header.of_options(o)
    container.write_container(codec.compress(planes, o, book), path, head, book)
    back = data_of(reports.open_container(spark, path))
    assert back.shape == volume_.shape
    if book is not None:
        assert (back == data_of(codec.quantize(planes, o, book))).all()
    if mode is not Mode.MIDDLE_PLANE:  # one plane's tiles tell little of other planes of noise
        assert ((back - volume_) ** 2).mean() < ((volume_ - volume_.mean()) ** 2).mean()
    text = reports.inspect(spark, path, True)
    assert "valid: yes" in text and text.count("bytes") >= head.chunks
    with open(path, "ab") as f:
        f.write(b"x")
    assert "valid: no" in reports.inspect(spark, path)
    with pytest.raises(Exception):
        reports.open_container(spark, path)


@pytest.mark.parametrize("tile", [None, Dims(3), Dims(3, 2), Dims(3, 3, 3)])
@pytest.mark.parametrize("mode", [Mode.GLOBAL, Mode.INDIVIDUAL])
def test_coding_from_the_file_equals_coding_of_planes(spark, tmp_path, tile, mode):
    if mode is Mode.INDIVIDUAL and tile and tile.z > 1:
        return
    dims, rng = Dims(7, 5, 8), np.random.default_rng(3)
    data = rng.integers(0, 65536, dims.count).astype(">u2")
    (tmp_path / "v.raw").write_bytes(data.tobytes())
    for planes in (None, (2, 6)):
        o = QuantOptions(dims, 3, tile, mode, path=str(tmp_path / "v.raw"), planes=planes)
        rows = raw.read(spark, o.path, dims)
        book = None if mode is Mode.INDIVIDUAL else codec.train(rows, o)
        want, got = (sorted(map(tuple, df.collect())) for df in (codec.compress(rows, o, book), codec.compress_raw(spark, o, book)))
        assert got == want and got


def test_huffman_walks():
    """Segments followed side by side meet the true walk, or are followed bit by bit where they don't."""
    rng = np.random.default_rng(5)
    for counts in ([1] * 256, [1] * 200, [int(1.7**i) for i in range(40)], [5], (1e6 * rng.random(256) ** 8).astype(int).tolist()):
        code = HuffmanCode(counts)
        p = (np.array(counts) + 0.01) / (np.array(counts) + 0.01).sum()
        for weights in (p, None):
            symbols = rng.choice(len(counts), 20_000, p=weights)
            payload = code.encode(symbols)
            assert (code.decode(payload, len(symbols)) == symbols).all()
            with pytest.raises(ValueError):
                code.decode(payload[:-2], len(symbols))
        assert len(code.decode(b"", 0)) == 0


def test_selection(spark):
    planes = planes_of(spark, np.arange(60, dtype=np.int32).reshape(10, 6))
    o = QuantOptions(Dims(3, 2, 10), 8, planes=(4, 6))
    book = codec.train(planes, o)
    chunks = codec.compress(planes, QuantOptions(Dims(3, 2, 10), 8, mode=Mode.GLOBAL, planes=(4, 6)), book)
    back = codec.decompress(chunks, Dims(3, 2, 3), None, 256, book, first=4)
    assert [r["z"] for r in back.orderBy("z").collect()] == [4, 5, 6]
    assert np.abs(data_of(back) - np.arange(24, 42).reshape(3, 6)).max() <= 1


def test_raw_files(spark, tmp_path):
    raw.register(spark)
    planes = planes_of(spark, np.arange(24, dtype=np.int32).reshape(3, 8))
    path = str(tmp_path / "v.raw")
    planes.write.format("u16raw").mode("append").save(path)
    assert open(path, "rb").read().hex() == "".join(f"{i:04x}" for i in range(24))
    got = spark.read.format("u16raw").option("dims", "4x2x3").load(path)
    assert (data_of(got.filter("z >= 1")) == np.arange(8, 24).reshape(2, 8)).all()
    assert got.count() == 3 and data_of(raw.read(spark, path, Dims(4, 2, 3), (1, 2))).tolist() == np.arange(8, 24).reshape(2, 8).tolist()
    assert data_of(got.filter(F.col("z").isin(2, 0)))[1].tolist() == list(range(16, 24))
    assert spark.read.format("u16raw").option("dims", "4x2x3").option("planes", "1-1").load(path).count() == 1
    with pytest.raises(Exception):
        spark.read.format("u16raw").option("dims", "4x2x4").load(path).count()
    diff = metrics.difference(planes, planes.select("z", F.transform("data", lambda v: v + 1).alias("data")))
    diff.write.format("u16raw").option("sample", "i32").option("endian", "little").mode("append").save(str(tmp_path / "d.raw"))
    assert (np.fromfile(tmp_path / "d.raw", dtype="<i4") == -1).all()


def test_store_and_commands(spark, tmp_path):
    path, store = str(tmp_path / "v.raw"), str(tmp_path / "store")
    rng = np.random.default_rng(7)
    v = rng.integers(0, 5000, (5, 36)).astype(np.int32)
    v.astype(">u2").tofile(path)
    quiet = lambda m: None
    reports.run_command(spark, ["-tcb", "-vq", "3x3", "-b", "2", "-o", store, path, "6x6x5"], quiet)
    assert codebooks.available(spark, store, "v.raw", Dims(3, 3)) == [2] and not codebooks.exists(spark, store, "v.raw", 8, Dims(3, 3))
    head = reports.run_command(spark, ["-c", "-vq", "3x3", "-b", "2", "-cbc", store, path, "6x6x5"], quiet)
    assert head.chunks == 5 and not head.book_each
    reports.run_command(spark, ["-d", path + CONTAINER_SUFFIX, "-o", str(tmp_path / "back.raw")], quiet)
    assert np.fromfile(tmp_path / "back.raw", dtype=">u2").size == v.size
    lines = []
    reports.run_command(spark, ["-i", path + CONTAINER_SUFFIX], lines.append)
    assert "valid: yes" in lines[0]
    assert reports.run_command(spark, ["-bench", "-sq", "-b", "8", path, "6x6x5", "1"], quiet).first()["mae"] < 30
    book = codebooks.load(spark, store, "v.raw", 4, Dims(3, 3))
    file = codebooks.export_file(str(tmp_path), "v.raw", book)
    assert "9 9 9" not in reports.inspect(spark, file, True) and codebooks.files_in(str(tmp_path)) == [file.rsplit("/", 1)[1]]
    planes = spark.read.format("u16raw").option("dims", "6x6x5").load(path)
    assert len(reports.train_and_save_all(planes, QuantOptions(Dims(6, 6, 5), store=store, train_name="all"))) == 8
    assert codebooks.available(spark, store, "all") == list(range(1, 9))
    assert reports.differences_in_folder(planes, str(tmp_path), 2, Dims(6, 6, 5)).count() == 2
    reports.write_train_log(spark, scalar.train(planes, 4).log, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).first()["value"] == "It;MSE;PSNR"


def test_byte_functions(spark):
    df = spark.createDataFrame([([0, 1, 258, 65535], [-1, 7])], "a array<int>, b array<int>")
    row = df.select(arrays.bytes_of_samples("a").alias("x"), arrays.samples_of_bytes(arrays.bytes_of_samples("a", True), True).alias("y"), arrays.bytes_of_ints("b", True).alias("z")).first()
    assert bytes(row["x"]).hex() == "000000010102ffff" and row["y"] == [0, 1, 258, 65535] and bytes(row["z"]).hex() == "ffffffff07000000"
    with pytest.raises(Exception):
        spark.range(1).select(arrays.checked16(F.lit(70000))).collect()
    assert spark.range(1).select(arrays.unsigned16(F.lit(-1))).first()[0] == 65535


def test_images(spark, tmp_path):
    for i in range(3):
        page = np.full((2, 3), i * 1000, dtype=">u2")
        (tmp_path / f"p{i}.pgm").write_bytes(b"P5 3 2 65535\n" + page.tobytes())
    planes, dims = memory.volume_of_images(memory.from_images(spark, str(tmp_path)))
    assert dims == Dims(3, 2, 3) and data_of(planes)[:, 0].tolist() == [0, 1000, 2000]
