"""Volumes of very many small planes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantavol.operators import codec, scalar, tiling, vector
from quantavol.operators.huffman import HuffmanCode
from quantavol.options import Dims, Mode, OptionError, Quantization, QuantOptions
from quantavol.plans import catalogue, reports
from quantavol.sources import container, files, raw
from quantavol.streaming import chunks as streams

DEEP = 70_000


def deep_planes(spark):
    z = F.col("id").cast("int")
    return spark.range(DEEP, numPartitions=5).select(z.alias("z"), F.array(z % 65536, z % 7).alias("data"))


def test_deep_header():
    deep = container.Header(Quantization.SCALAR, 4, False, Dims(4, 2, DEEP), None)
    assert deep.pack()[:25].hex() == "51434d504445455000040000040002" + "00011170" + "000000000000"
    assert container.Header.unpack(deep.pack()) == container.Header(Quantization.SCALAR, 4, False, Dims(4, 2, DEEP), None, [0] * DEEP)
    with pytest.raises(OptionError):
        container.Header.unpack(deep.pack()[:15] + bytes([0, 0, 0, 3]) + bytes(40))
    assert container.Header(Quantization.SCALAR, 4, False, Dims(4, 2, 65535), None).pack()[:8] == b"QCMPFILE"


def test_commands_on_deep_volume(spark, tmp_path):
    """file to file, with a codebook for each plane."""
    path = str(tmp_path / "v.raw")
    raw.register(spark)
    deep_planes(spark).repartition(7).write.format("u16raw").mode("append").save(path)
    want = np.stack([np.arange(DEEP) % 65536, np.arange(DEEP) % 7], axis=1).astype(">u2").tobytes()
    assert files.read_all(path) == want and files.names_in(str(tmp_path)) == ["v.raw"]
    reports.run_command(spark, ["-c", "-vq", "2x1", "-b", "1", "-o", f"{path}.volume", path, f"2x1x{DEEP}"], lambda line: None)
    reports.run_command(spark, ["-d", "-o", f"{path}.back", f"{path}.volume"], lambda line: None)
    assert files.read_all(f"{path}.back") == want


def deep_container(spark, path):
    options = QuantOptions(Dims(2, 1, DEEP), 8, mode=Mode.GLOBAL)
    book = scalar.ScalarCodebook(np.arange(256) * 256, np.ones(256, dtype=np.int64))
    chunks = codec.compress(deep_planes(spark), options, book)
    container.write_container(chunks.repartition(6, F.hash("chunk")), path, container.Header.of_options(options), book)
    return book


def test_deep_container_is_inspected(spark, tmp_path):
    """chunks and their places are those of the file."""
    path = str(tmp_path / "v.volume")
    deep_container(spark, path)
    chunks, head, _ = container.read_container(spark, path)
    row = reports.inspect_frame(chunks, head).agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes"), F.max("offset").alias("last")).first()
    assert (row["n"], row["bytes"], row["last"]) == (DEEP, 2 * DEEP, head.size + 2 * (DEEP - 1))
    assert reports.inspect(spark, path).endswith("valid: yes")


@pytest.mark.parametrize(("depth", "mark"), [(65_535, b"QCMPFILE"), (65_536, b"QCMPDEEP")])
def test_container_inspect_at_the_limit(spark, tmp_path, monkeypatch, depth, mark):
    """the query itself, over the most planes that the known header holds and over one more."""
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    sample = lambda i: (((F.col("id") * 31 + i * 17) % 201) / 100.0 - 1.0).cast("float")
    rows = spark.range(depth, numPartitions=4).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(63)), sample).alias("embedding"))
    rows.write.parquet(f"{folder}/embeddings.parquet")
    monkeypatch.setattr(catalogue, "scratch", lambda spark, name: store)
    assert [tuple(r) for r in catalogue.queries()["container_inspect"](spark, folder).collect()] == [(depth, True)]
    head = container.read_header(f"{store}/v.volume")
    assert files.read_range(f"{store}/v.volume", 0, 8) == mark and head.dims == Dims(8, 8, depth) and len(head.sizes) == depth


def test_deep_container_roundtrip(spark, tmp_path):
    """planes come back in their order, though chunks were written in another."""
    path = str(tmp_path / "v.volume")
    book = deep_container(spark, path)
    back = np.array([r["data"] for r in reports.open_container(spark, path).orderBy("z").collect()])
    samples = np.stack([np.arange(DEEP) % 65536, np.arange(DEEP) % 7], axis=1)
    assert (back == book.decode(book.encode(samples.ravel())).reshape(-1, 2)).all()


def test_small_planes_are_dealt(spark, tmp_path):
    """Many small planes make several partitions, however few bytes they have."""
    assert files.items_each(100_000, 128) == 1563 and files.items_each(500, 128) == 256 and files.items_each(900, 2 << 20) == 4
    path = str(tmp_path / "v.raw")
    files.write_all(path, [bytes(4 * DEEP)])
    assert raw.read(spark, path, Dims(2, 1, DEEP)).rdd.getNumPartitions() == 64


def test_staged_items_are_joined_in_order(tmp_path):
    rng = np.random.default_rng(5)
    order, folder = rng.permutation(500), str(tmp_path / "parts")
    staged = [s for k in range(90) for s in files.stage(folder, ((int(i), b"%d;" % i) for i in order[k::90]))]
    assert len(staged) == len(files.names_in(folder)) == 90 and files.stage(folder, iter([])) == []
    joined = files.Joined(staged)
    assert joined.numbers.tolist() == list(range(500)) and b"".join(joined.data()) == b"".join(b"%d;" % i for i in range(500))


def test_interleaved_parts_are_opened_once(tmp_path, monkeypatch):
    """planes in any order over many tasks; a commit doesn't open a file for each of them."""
    order, folder = np.random.default_rng(4).permutation(3000), str(tmp_path / "parts")
    staged = [s for k in range(90) for s in files.stage(folder, ((int(i), b"%d;" % i) for i in order[k::90]))]
    opened, locate = [], files.locate
    monkeypatch.setattr(files, "locate", lambda uri: opened.append(uri) or locate(uri))
    assert b"".join(files.Joined(staged).data()) == b"".join(b"%d;" % i for i in range(3000))
    assert len(opened) == len(set(opened)) == 90


def test_joined_runs_of_all_lengths(tmp_path, monkeypatch):
    for name, size in (("AT_ONCE", 50), ("WINDOW", 120), ("NEAR", 9)):
        monkeypatch.setattr(files, name, size)
    rng, folder = np.random.default_rng(7), str(tmp_path / "parts")
    items = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in rng.choice([0, 1, 7, 30, 49, 50, 51, 170], 400)]
    owner = np.repeat(rng.integers(0, 5, 100), rng.choice([1, 2, 5], 100))[: len(items)]
    owner = np.append(owner, rng.integers(0, 5, len(items) - len(owner)))
    staged = [s for k in range(5) for s in files.stage(folder, ((int(i), items[i]) for i in np.flatnonzero(owner == k)[:: 1 - 2 * (k % 2)]))]
    assert b"".join(files.Joined(staged).data()) == b"".join(items)
    files.write_all(staged[2].name, [files.read_all(staged[2].name)[:-1]])
    with pytest.raises(OSError):
        list(files.Joined(staged).data())


def test_small_layers_share_a_group(spark, monkeypatch):
    """layers are tiled and coded many at once, whatever the order of planes; the last is deeper."""
    rng = np.random.default_rng(3)
    volume = rng.integers(0, 65536, (47, 12))
    planes = spark.createDataFrame([(int(z) + 5, volume[z].tolist()) for z in rng.permutation(47)], "z int, data array<int>").repartition(3)
    dims, tile = Dims(4, 3, 47), Dims(2, 2, 2)
    boxes = [volume[2 * i : 47 if i == 22 else 2 * i + 2].ravel() for i in range(23)]
    want = [tiling.gather(b, Dims(4, 3, len(b) // 12), tile).tolist() for b in boxes]
    for layers in (1, 4, 256):
        monkeypatch.setattr(tiling, "GROUP_LAYERS", layers)
        sizes = tiling.by_layers(planes, dims, 2, 5, lambda n, z, box: pa.RecordBatch.from_pydict({"n": pa.array([n]), "a": pa.array([int(z[0])]), "b": pa.array([len(z)])}), "n long, a long, b long")
        assert sorted(tuple(r) for r in sizes.collect()) == [(i, 2 * i + 5, 3 if i == 22 else 2) for i in range(23)]
        got = {}
        for r in tiling.tiles(planes, dims, tile, first=5).orderBy("z", "vec_ix").collect():
            got.setdefault(r["z"], []).append(r["vec"])
        assert [got[i] for i in range(23)] == want


def test_small_planes_share_a_batch(spark, monkeypatch):
    """vectors of many planes are passed on together, those of each plane in order."""
    volume = np.random.default_rng(11).integers(0, 65536, (9, 12))
    one = tiling.vector_batch((4, volume[:2, :6]), (7, volume[:1, 6:]))
    assert one.column("z").to_pylist() == [4, 4, 7] and one.column("vec_ix").to_pylist() == [0, 1, 0] and one.column("vec").to_pylist() == [*volume[:2, :6].tolist(), volume[0, 6:].tolist()]
    planes = spark.createDataFrame([(z, v) for z, v in enumerate(volume.tolist())], "z int, data array<int>").coalesce(1)
    want = [(z, i, v) for z in range(9) for i, v in enumerate(tiling.gather(volume[z], Dims(4, 3), Dims(3, 2)).tolist())]
    for most in (1, 60, 1 << 20):
        monkeypatch.setattr(tiling, "GROUP_SAMPLES", most)
        assert [tuple(r) for r in tiling.tile_planes(planes, Dims(4, 3), Dims(3, 2)).collect()] == want


def test_small_boxes_share_a_batch(spark, monkeypatch):
    monkeypatch.setattr(codec, "MOST_ROWS", 3)
    assert list(streams._at_once((i, str(i), 1) for i in range(7))) == [(0, ["0", "1", "2"]), (3, ["3", "4", "5"]), (6, ["6"])]
    assert list(streams._at_once((i, i, files.AT_ONCE) for i in range(2))) == [(0, [0]), (1, [1])] and list(streams._at_once(iter([]))) == []
    rng = np.random.default_rng(2)
    book = vector.VectorCodebook(rng.integers(0, 65536, (256, 4)), np.ones(256, dtype=np.int64), Dims(2, 1, 2))
    boxes = [(i, 2, 2, 1 + i % 5, rng.integers(0, 65536, 4 * (1 + i % 5)).tolist()) for i in range(20)]
    frame = spark.createDataFrame(boxes, streams.BOXES).coalesce(1)
    back = streams.decode_boxes(streams.encode_boxes(frame, book.tile, book), book.tile, book).orderBy("id").collect()
    code = HuffmanCode(book.frequencies)
    want = [streams.decode_box(streams.encode_box(np.array(d), Dims(x, y, z), book.tile, book, code), book.tile, book, code) for _, x, y, z, d in boxes]
    assert [(r["id"], Dims(r["x"], r["y"], r["z"]), r["data"]) for r in back] == [(i, dims, d.tolist()) for i, (dims, d) in enumerate(want)]


def test_short_payloads_need_no_tables():
    rng = np.random.default_rng(6)
    for counts in ([1, 1], [5, 0, 0, 9, 2], [2**i for i in range(24)], rng.integers(0, 1000, 256).tolist()):
        short, long = HuffmanCode(counts), HuffmanCode(counts)
        long.tables()
        s = rng.integers(0, len(counts), 700)
        payload = short.encode(s)
        assert (short.decode(payload, 700) == s).all() and (long.decode(payload, 700) == s).all() and short._windows is None
        for code in (short, long):
            with pytest.raises(ValueError):
                code.decode(payload[:-2], 700)
    lone = HuffmanCode([7])
    assert lone.decode(lone.encode(np.zeros(9, dtype=np.int64)), 9).tolist() == [0] * 9
