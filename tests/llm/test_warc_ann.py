import gzip
import io
import zipfile

import numpy as np
import pyarrow as pa
import pytest

from quantavol.llm import ann, warc


def reader(data):
    return pa.PythonFile(io.BytesIO(data), mode="r")


@pytest.mark.parametrize("zip64", [False, True])
def test_zip(zip64):
    members = [("a/é.bin", b"x" * 1000), ("empty", b""), ("b", bytes(range(256)))]
    data = warc.zip_bytes(members, zip64)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and [(i.filename, z.read(i)) for i in z.infolist()] == members
    for raw in (data, b"junk" * 3 + data[:0] + b""):
        if raw is data:
            f = reader(raw)
            got = warc.read_directory(f)
            assert [(m.name, f.read_at(m.size, warc.data_at(f, m))) for m in got] == members
        else:
            with pytest.raises(ValueError):
                warc.read_directory(reader(raw))


def test_foreign_zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"a comment"
        z.writestr("stored", b"hello")
        z.writestr(zipfile.ZipInfo("packed"), b"hello" * 50, zipfile.ZIP_DEFLATED)
    f = reader(out.getvalue())
    stored, packed = warc.read_directory(f)
    assert f.read_at(stored.size, warc.data_at(f, stored)) == b"hello"
    with pytest.raises(ValueError):
        warc.data_at(f, packed)


def test_records():
    payload = "<p>é\r\n\r\nWARC/1.1</p>".encode()
    got, n = warc.parse_record(warc.record_bytes("7", "http://x/\r\nX: y", payload, None) + b"rest")
    assert got.payload == payload and got.page("warc-record-id") == "7" and got.headers["warc-record-id"] == "<urn:page:7>" and "\n" not in got.headers["warc-target-uri"]
    again, _ = warc.parse_record(warc.record_bytes("9", None, payload, "7"))
    assert again.payload == b"" and again.page("warc-refers-to") == "7" and again.http["content-length"] == str(len(payload))
    assert again.headers["warc-payload-digest"] == got.headers["warc-payload-digest"] == "sha1:" + warc.base32_sha1(payload)
    with pytest.raises(ValueError):
        warc.parse_record(b"nothing")


def test_archive_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 600)
    html = ["same", "same", None, "", "other" * 300, "same", "é" * 900]
    rows = [(i, f"http://h/{i}" if i % 2 else None, h, 1) for i, h in enumerate(html)] + [(None, None, "same", 1), (5, "u", "same", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = sorted((tuple(r) for r in warc.archive_pages(spark, df).collect()), key=str)
    want = []
    for i, _, h, _ in rows:
        p = (h or "").encode()
        first = min(j for j, _, k, _ in rows if j is not None and (k or "") == (h or ""))
        want.append((i, len(p), warc.base32_sha1(p), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=str)
    assert {r["record_type"] for r in warc.archive_pages(spark, df, min_bytes=10_000).collect()} == {"response"}
    assert warc.archive_pages(spark, df.limit(0)).count() == 0
    from quantavol.llm._common import Stage

    stage = Stage(spark, "t")
    files = stage.table(warc.write_packages(warc.mark_revisits(df), f"{stage.path}/p", zip64=True), "m")
    back = {(r["id"], r["record_type"]): r["payload"] for r in warc.read_packages(files, payloads=True).collect()}
    assert files.count() > 1 and bytes(back["6", "response"]) == ("é" * 900).encode()


def test_plain_archive():
    records = [(str(i), None, "X", warc.record_bytes(str(i), None, bytes([i]) * i, None)) for i in range(5)]
    assert sorted(r.payload for r in warc.read_package(reader(warc.package(records)))) == [bytes([i]) * i for i in range(5)]


def foreign_package(compress):
    """A package as others make them: two archives, a gzipped index, warcinfo and request records, no digests."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n"
    record = lambda kind, rid, block, more=b"": b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:uuid:" + rid + b">\r\n" + more + b"Content-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    one = [record(b"warcinfo", b"a", b"software: x\r\n"), record(b"response", b"b", http + b"hello", b"WARC-Target-URI: http://www.x.org/a\r\n")]
    two = [record(b"request", b"c", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n"), record(b"revisit", b"d", b"", b"WARC-Refers-To: <urn:uuid:b>\r\n"), record(b"resource", b"e", b"raw")]
    lines, members = [b"!meta 0 {\"format\": \"cdxj\"}"], []
    for name, records in (("one.warc", one), ("two.warc", two)):
        name, data = name + (".gz" if compress else ""), b""
        for r in records:
            r = gzip.compress(r) if compress else r
            lines.append(b'org,x)/a 20240102030405 {"offset": "%d", "length": "%d", "filename": "%s"}' % (len(data), len(r), name.encode()))
            data += r
        members.append((f"archive/{name}", data))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in [("datapackage.json", b"{}"), *members, ("indexes/index.cdx.gz", gzip.compress(b"\n".join(lines))), ("pages/pages.jsonl", b"{}")]:
            z.writestr(name, data)
    return out.getvalue()


@pytest.mark.parametrize("compress", [False, True])
def test_foreign_packages(spark, tmp_path, compress):
    (tmp_path / "x.wacz").write_bytes(foreign_package(compress))
    got = warc.read_packages(spark.createDataFrame([(f"file://{tmp_path}/x.wacz",)], "path string"), payloads=True).collect()
    got = {r["id"]: (r["record_type"], r["uri"], r["refers_to"], r["payload_bytes"], r["payload_digest"], bytes(r["payload"])) for r in got}
    assert got["urn:uuid:b"] == ("response", "http://www.x.org/a", None, 5, warc.base32_sha1(b"hello"), b"hello")
    assert got["urn:uuid:d"][:5] == ("revisit", None, "urn:uuid:b", None, None)
    assert got["urn:uuid:e"][5] == b"raw" and got["urn:uuid:a"][0] == "warcinfo" and got["urn:uuid:c"][0] == "request" and len(got) == 5


def test_string_ids(spark):
    """Any string is an id: empty, with brackets and line ends; null stays null."""
    ids = ["", "a>b\r\nX: y", "é %41", "urn:page", None, "b"]
    df = spark.createDataFrame([(i, "u", "same") for i in ids], "page_id string, url string, html string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(spark, df).collect()), key=str)
    assert got == sorted([(i, "response" if i == "" else "revisit", None if i == "" else "") for i in ids], key=str)


def test_sort_keys():
    assert warc.sort_key("http://WWW.Example.com:8080/A b?q=1") == "com,example,www:8080)/a%20b?q=1"
    assert warc.sort_key("urn:page:7") == "urn:page:7" and warc.sort_key("http://[bad") == "http://%5Bbad"
    line = b'com,example)/ 20200101000000 {"url": "http://example.com/", "offset": "12", "length": "7", "filename": "a.warc"}'
    assert list(warc.index_lines(b"!hdr\n" + line)) == [("a.warc", 12, 7)]


def brute(rows, queries, k):
    out = {}
    for q, y in queries:
        scores = sorted(((float(np.dot(np.float64(x), np.float64(y))), i) for i, x in rows if i != q), key=lambda s: (-s[0], s[1]))
        out[q] = [i for _, i in scores[:k]]
    return out


def test_search(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 16))) * rng.uniform(0.5, 2, (900, 1))
    good = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(1000 + i, [float(v) for v in x[3]]) for i in range(40)]
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, [float("inf")] + [0.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").repartition(4)
    forest = ann.Forest(trees=24, descent=32, part_rows=128, block_bytes=1 << 14)
    got = ann.search_embeddings(spark, df, 20, 20, forest).collect()
    queries = [(i, y) for i, y in good if i % 20 == 0]
    want = brute(good, queries, 20)
    found = {q: [] for q, _ in queries}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append(r["vec_id"])
        assert r["score"] == pytest.approx(float(np.dot(dict(good)[r["vec_id"]], dict(good)[r["query_id"]])))
    assert all(len(v) == 20 and q not in v for q, v in found.items())
    assert sum(len(set(found[q]) & set(want[q])) for q in want) / (20 * len(want)) >= 0.9
    scores = {(r["query_id"], r["rank"]): r["score"] for r in got}
    assert all(scores[q, k] >= scores[q, k + 1] for q in found for k in range(1, 20))


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search_embeddings(spark, df).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 3, 0.0), (0, 3, 4, -1.0), (20, 1, 0, 1.0), (20, 2, 3, 0.0), (20, 3, 4, -1.0)]
    assert ann.search_embeddings(spark, df.limit(0)).count() == 0


def test_ties_go_to_smaller_ids(spark):
    """400 different vectors with inner product exactly 1, and others below: the smallest ids win."""
    rng = np.random.default_rng(4)
    rows = [(0, [1.0] + [0.0] * 7)]
    rows += [(1 + i, [1.0, *(0.001 * rng.integers(-9, 9, 7)).tolist()]) for i in range(400)]
    rows += [(500 + i, [-1.0, *rng.normal(size=7).tolist()]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = [(r["vec_id"], r["score"]) for r in ann.search(spark, df, df.filter("vec_id = 0"), 20).orderBy("rank").collect()]
    assert got == [(i, 1.0) for i in range(1, 21)]


def test_search_columns_and_repeats(spark):
    """Other columns may have the names used within; repeated rows count once; small parts and blocks."""
    rng = np.random.default_rng(8)
    x = rng.integers(-3, 4, (300, 6)).astype(float)
    rows = [(i, v.tolist(), 1, 2, 3, "s", 4, 5, 6) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + rows[:50], "vec_id long, embedding array<double>, block int, pos int, q int, tree string, part int, score int, ids int")
    forest = ann.Forest(trees=48, part_rows=32, block_bytes=2000, miss=0.01, crowd=20)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search_embeddings(spark, df, 20, 5, forest).collect())
    want = brute([(r[0], r[1]) for r in rows if any(r[1])], [(r[0], r[1]) for r in rows if r[0] % 20 == 0 and any(r[1])], 5)
    found = {q: [g[2] for g in got if g[0] == q] for q in want}
    assert all(len(found[q]) == 5 for q in want)
    assert sum(len(set(found[q]) & set(want[q])) for q in want) / (5 * len(want)) >= 0.9


def test_only_candidates_are_scored():
    """A range is scored for its own queries and no others."""
    x, ids = np.arange(12.0).reshape(6, 2), pa.array([[0], [1], [2], [3], [4], [5]])
    message = ann.squeeze(*(np.array(v, dtype=k) for v, k in (([2, 1], "<u4"), ([0, 1, 5], "<u4"), ([1, 2], "<u4"), ([7, 7, 9], "<i8"))))
    q, v, s = ann.best_of_block(x, ids, np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([7, 9]), np.array([5, 100]), np.array([0.0, -9.0]), [message], 2)
    assert list(zip(q.tolist(), v.tolist(), s.tolist())) == [(7, 1, 2.0), (7, 0, 0.0), (9, 5, 11.0)]
