import struct

import numpy as np
import pytest

from quantavol.operators.huffman import HuffmanCode, read_fixed, write_fixed
from quantavol.operators.scalar import ScalarCodebook
from quantavol.operators.vector import VectorCodebook
from quantavol.options import CONTAINER_SUFFIX, Dims, Method, Mode, OptionError, Quantization, QuantOptions, default_output, elapsed, parse_dims, parse_range
from quantavol.sources import codebooks, container, memory


def test_header_bytes():
    sq = container.Header(Quantization.SCALAR, 4, False, Dims(4, 2, 3), None)
    assert sq.pack()[:23].hex() == "51434d5046494c45000400000400020003000000000000" and sq.size == 35
    vq = container.Header(Quantization.VECTOR_3D, 2, False, Dims(8, 8, 8), Dims(3, 3, 3))
    assert vq.pack()[:23].hex() == "51434d5046494c45030200000800080008000300030003" and vq.chunks == 2 and vq.size == 31
    assert container.Header.unpack(vq.pack()) == container.Header(Quantization.VECTOR_3D, 2, False, Dims(8, 8, 8), Dims(3, 3, 3), [0, 0])
    with pytest.raises(OptionError):
        container.Header.unpack(b"x" * 40)
    bad = container.Header(Quantization.INVALID, 0, False, Dims(0, 1, 1), None)
    assert len(bad.problems()) == 3
    with pytest.raises(OptionError):
        container.Header(Quantization.SCALAR, 4, False, Dims(70000, 2, 3), None).pack()


def test_codebook_file_bytes():
    book = ScalarCodebook(np.array([10, 21, 40, 100]), np.array([5, 1, 1, 3]))
    data = codebooks.file_bytes("a.raw", book)
    assert data.hex() == "51434d5043414348450000040005612e726177000000000000000a0015002800640000000000000005000000000000000100000000000000010000000000000003"
    name, back = codebooks.of_file_bytes(data)
    assert name == "a.raw" and back.centroids.tolist() == [10, 21, 40, 100] and back.frequencies.tolist() == [5, 1, 1, 3]
    vq = VectorCodebook(np.arange(8).reshape(4, 2), np.array([1, 2, 3, 4]), Dims(2))
    name, back = codebooks.of_file_bytes(codebooks.file_bytes("v", vq))
    assert back.tile == Dims(2) and (back.vectors == vq.vectors).all()
    with pytest.raises(OptionError):
        codebooks.of_file_bytes(data[:-1])
    assert codebooks.file_name("t", 4, None) == "t_4_bits.qvc" and codebooks.file_name("t", 4, Dims(3, 3)) == "t_4_3x3x1.qvc"


def test_huffman():
    code = HuffmanCode([8, 4, 2, 1])
    assert code.codes == ["0", "10", "110", "111"] and code.total_bits == 25
    assert code.encode(np.array([0, 1, 2, 3, 0, 0, 1])).hex() == "5b90"
    assert HuffmanCode([5, 1, 1, 3]).total_bits == 17 and HuffmanCode([4, 0, 0, 0]).total_bits == 4
    assert HuffmanCode([7]).codes == ["0"]
    rng = np.random.default_rng(2)
    for counts in ([1, 1], [5, 0, 0, 9, 2], [2**i for i in range(24)], rng.integers(0, 1000, 256).tolist()):
        code = HuffmanCode(counts)
        assert sum(2.0 ** -len(c) for c in code.codes) == 1
        s = rng.integers(0, len(counts), 500)
        payload = code.encode(s)
        assert (code.decode(payload, 500) == s).all()
        with pytest.raises(ValueError):
            code.decode(payload[:-2], 500)
    assert HuffmanCode([1, 3]).probabilities() == [(1, 0.75), (0, 0.25)]


def test_fixed_width():
    assert write_fixed([1, 2, 3], 3).hex() == "8b00"  # 100 010 110
    assert read_fixed(write_fixed([5, 0, 7, 2], 3), 3, 4).tolist() == [5, 0, 7, 2]
    with pytest.raises(ValueError):
        read_fixed(b"\0", 5, 3)


def test_stream_chunk():
    data = container.stream_chunk(Dims(4, 2, 3), [b"abc", b"", b"de"])
    assert data[:8] == struct.pack(">4H", 4, 2, 3, 3) and len(data) == 8 + 5 + 6
    assert container.parse_stream_chunk(data) == (Dims(4, 2, 3), [b"abc", b"", b"de"])
    with pytest.raises(ValueError):
        container.parse_stream_chunk(data[:-1] + b"\x09")


def test_options():
    assert parse_dims("3 x 2") == Dims(3, 2) and parse_dims("axb") is None and parse_range("3-7") == (3, 7) and parse_range("7-3") is None
    assert Quantization.of_tile(Dims(5, 1, 2)) is Quantization.VECTOR_3D and Quantization.of_code(9) is Quantization.INVALID
    assert elapsed(3_723_004) == "1 H 2 min 3 sec 4 ms" and elapsed(5) == "5 ms"
    assert default_output("a.raw", Method.COMPRESS) == "a.raw" + CONTAINER_SUFFIX and default_output("a.raw" + CONTAINER_SUFFIX, Method.DECOMPRESS) == "a.raw"
    o = QuantOptions.from_args(["-c", "-vq", "3x3", "-b", "4", "-mp", "v.raw", "8x8x10", "2-5"])
    assert (o.kind, o.bits, o.mode, o.planes, o.plane_count, o.output) == (Quantization.VECTOR_2D, 4, Mode.MIDDLE_PLANE, (2, 5), 4, "v.raw" + CONTAINER_SUFFIX)
    assert o.training_planes() == (5, 5) and "vector_2d" in o.report()
    assert len(QuantOptions.from_args(["-c", "-b", "x", "v.raw", "8yx", "z"]).problems) == 4
    with pytest.raises(OptionError):
        QuantOptions(Dims(4, 4, 4), 9, Dims(2, 2, 2), plane=7).validate()


def test_images():
    page = np.arange(12, dtype=np.uint16).reshape(3, 4) * 5000
    pgm = b"P5\n# note\n4 3\n65535\n" + page.astype(">u2").tobytes()
    assert (memory.read_image(pgm)[0] == page).all()
    for order in "<>":
        raw = page.astype(order + "u2").tobytes()
        tags = [(256, 3, 1, 4), (257, 3, 1, 3), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 3, 1, 3), (279, 4, 1, len(raw))]
        entry = b"".join(struct.pack(order + "HHI", t, k, n) + struct.pack(order + ("I" if k == 4 else "HH"), *([v] if k == 4 else [v, 0])) for t, k, n, v in tags)
        tiff = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(raw)) + raw + struct.pack(order + "H", len(tags)) + entry + struct.pack(order + "I", 0)
        assert (memory.read_image(tiff)[0] == page).all()
    with pytest.raises(ValueError):
        memory.read_image(b"GIF89a")
