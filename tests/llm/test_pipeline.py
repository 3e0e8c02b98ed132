import random

import pytest

import corpus_pipeline
from quantavol.llm import neardup
from quantavol.llm.queries import oracle_sql, queries


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11)) and set(oracle_sql()) <= set(queries())
    assert len(corpus_pipeline.STAGES) == 5


def test_stages(spark, tmp_path, corpus):
    docs = spark.createDataFrame([(i, x, lang, s, len(x or "")) for i, x, lang, s in corpus], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    here = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, here, str(tmp_path))
        if k < 4:
            assert out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / f"s{k}"))
        here = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append(here)
    good, single, cut, mixed, packed = seen
    assert {r["doc_id"] for r in good.collect()}.isdisjoint({120, 121, 123, 129})
    assert neardup.near_duplicates(spark, single, 80).filter("not kept").count() == 0 and single.count() < good.count()
    texts = [r["text"] for r in cut.collect()]
    grams = [tuple(w[i : i + 20]) for w in (x.split() for x in texts) for i in range(len(w) - 19)]
    whole = sum(len(r["text"].split()) for r in single.collect())
    assert sum(len(x.split()) for x in texts) < whole and len(grams) - len(set(grams)) < 40
    assert 0.8 < sum(len(r["text"].split()) for r in mixed.collect()) / sum(len(x.split()) for x in texts) < 1.1
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mixed.collect()}


def test_near_dedup_of_repeated_rows(spark):
    """Copies with one doc_id leave one row; other texts of that doc_id and rows without one stay."""
    text, other = "a b c d e f g", "p q r s t u v w"
    rows = [(1, text, "x"), (1, text, "y"), (1, text, "x"), (2, text, "x"), (3, other, "x"), (4, None, "x"), (4, None, "x"), (5, "k l m n o p", "x"), (5, "z y x w v u", "x"), (None, "m n", "x"), (None, "m n", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = sorted((tuple(r) for r in corpus_pipeline.near_dedup(spark, df, "").collect()), key=str)
    want = [(1, text, "x"), (3, other, "x"), (4, None, "x"), (5, "k l m n o p", "x"), (5, "z y x w v u", "x"), (None, "m n", "x"), (None, "m n", "x")]
    assert got == sorted(want, key=str)


NAMES = ("n_words", "n_removed", "kept_text", "_text", "_id", "_p", "_gone", "_size", "_copies", "quality", "new_x", "mix_y", "key", "_row", "text_", "quality_n_words")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(i, i % 5 and 1) for i in range(40)] + [(None, 0), (3, None)], "doc_id long, quality int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(path / "none" / "labels.parquet"))
    return path


def odd_rows():
    """Null and repeated ids, null and empty texts, copies, ties."""
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + str(rng.randint(0, 60)) for _ in range(n))
    passage = text(30)
    out = [(i, text(70) + " " + passage, "s" if i % 3 else None) for i in range(20)]
    return out + [(5, out[5][1], "s"), (5, text(80), "s"), (None, text(90), None), (None, text(90), "t"), (21, None, "s"), (22, "", "s"), (23, out[0][1], "t"), (24, out[0][1] + " more", "t")]


def test_stages_with_clashing_names(spark, folder):
    names = ("doc_id", "text", "source", "lang", "n_chars", *NAMES)
    schema = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"{n} long" for n in NAMES)
    rows = [(i, x, s, "en", len(x or ""), *range(len(NAMES))) for i, x, s in odd_rows()]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, str(folder))
        if k < 4:
            assert out.columns == list(names), name
            assert all(tuple(r)[5:] == tuple(range(len(NAMES))) for r in out.collect()), name
        else:
            assert out.count() >= len(rows)
    kept = corpus_pipeline.near_dedup(spark, docs, str(folder)).select("doc_id").collect()
    assert sorted(str(r[0]) for r in kept) == sorted(str(i) for i in [*range(20), 5, None, None, 21, 22])


def test_empty_tables(spark, folder):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs, str(folder)).count() == 0, name
    some = spark.createDataFrame([(1, "w " * 30 + " ".join(f"v{i}" for i in range(60)), "en", "a", 5)], docs.schema)
    assert corpus_pipeline.quality_rules(spark, some, str(folder / "none")).count() == 1


def test_run_leaves_only_what_its_result_reads(spark, folder, tmp_path):
    from quantavol.llm._common import Stage

    rows = [(i, x, s, "en", len(x or "")) for i, x, s in odd_rows()]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(str(folder / "labels.parquet")).write.parquet(str(tmp_path / "labels.parquet"))
    made = len(Stage.made)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {s.path.rsplit("/", 1)[1].rsplit("-", 1)[0] for s in Stage.made[made:]} == {"pipeline", "packing"}
    Stage.release(made)
    assert len(Stage.made) == made
