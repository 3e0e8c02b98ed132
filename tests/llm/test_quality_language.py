import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from quantavol.llm import language, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w, seen, dup, covered = WORD.findall(text), set(), 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_statistics(spark, docs, corpus):
    got = {r["doc_id"]: r for r in quality.statistics(docs).collect()}
    for i, text, *_ in corpus:
        assert tuple(got[i][c] for c in quality.COUNTS) == counts(text)
    assert got[120]["chars_a_word"] == 0


def test_learned_list():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 1] <= 0.5) | (x[:, 2] > 0.95)
    rules = quality.learn(x, bad, ["a", "b", "c"])
    hit = np.zeros(600, dtype=bool)
    for r in rules.rules:
        hit |= quality._covers(list(r), x, ["a", "b", "c"])
    assert (hit == bad).mean() > 0.97 and 1 <= len(rules.rules) <= 6 and "reject if" in str(rules)
    assert quality.learn(x, np.zeros(600, dtype=bool), ["a", "b", "c"]).rules == []


def test_judge(spark, docs, corpus):
    labels = spark.createDataFrame([(i, int(i < 90)) for i in range(129)] + [(None, 0), (3, None)], "doc_id long, quality int")
    out, rules = quality.judge(spark, docs, labels)
    rows = {r["doc_id"]: r for r in out.collect()}
    for i, text, *_ in corpus:
        n, _, _, _, repeated = counts(text)
        assert rows[i]["base_failed"] == (n < 50 or 100 * repeated > 50 * n) and not (rows[i]["kept"] and rows[i]["base_failed"])
    none, empty = quality.judge(spark, docs, labels.limit(0))
    assert empty.rules == [] and none.filter("kept = base_failed").count() == 0
    kept = quality.keep_good(spark, docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == none.filter("kept").count()
    assert quality.judge(spark, docs.limit(0), labels)[0].count() == 0


def slow_grams(text):
    s = " " + re.sub(r"[^\w]|[\d_]", " ", text.lower()) + " "
    s = re.sub(" +", " ", s)
    out = Counter()
    for n in language.ORDERS:
        out.update(s[i : i + n] for i in range(len(s) - n + 1) if n > 1 or s[i] != " ")
    return out


def test_grams():
    texts = ["Ça va? It's", "", "12 ab", "é"]
    points, at, letters = language.characters(pa.array(texts))
    doc, code, times = language.counted(points, at, np.arange(len(texts)))
    for i, text in enumerate(texts):
        got = Counter(dict(zip(code[doc == i].tolist(), times[doc == i].tolist())))
        want = Counter()
        for g, n in slow_grams(text).items():
            v = 0
            for c in g:
                v = (v << language.CODE_BITS) | ((0 if c == " " else ord(c)) + 1)
            want[v] = n
        assert got == want
    assert letters.tolist() == [7, 0, 2, 1]


@pytest.mark.parametrize("text", ["Ça va? It's \n\n 12 über-Straße. " * 9, "  " * 40 + "é" * 90, "x" * 100, "日本語" * 30 + " a", ". " * 60])
def test_long_texts_by_pieces(monkeypatch, text):
    whole = language.counted_texts(pa.array([text]), np.array([3]))
    for most in (7, 16, 40):
        monkeypatch.setattr(language, "AT_ONCE", most)
        assert [x.tolist() for x in language.counted_texts(pa.array([text]), np.array([3]))] == [x.tolist() for x in whole]


def test_packed_order():
    rng = np.random.default_rng(3)
    g, n = np.sort(rng.integers(0, 9, 500)), rng.integers(1, 6, 500)
    assert (language.by_frequency(g, n) == np.lexsort((np.arange(500), -n, g))).all()
    assert (language.by_frequency(g + (1 << 60), n) == np.lexsort((np.arange(500), -n, g))).all()


def test_identify(spark, corpus):
    rng = random.Random(3)
    from conftest import words

    rows = [(i, " ".join(words(rng, 80, lang)), lang) for i, lang in enumerate(rng.choices(["en", "fr", "de"], k=200))]
    rows += [(900, None, "en"), (901, "12 ## ..", "fr"), (902, "", None), (None, "the of and", None)]
    out = language.identify(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {r[0]: r[2] for r in rows[:200]}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(out) == 204 and len(held) > 40
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902)) and by[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in out)


def test_nothing_learnt(spark, no_docs, docs):
    assert language.identify(spark, no_docs).count() == 0
    out = language.identify(spark, docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in out.collect()} == {"und"}


def test_profiles_equal_counting(spark):
    rows = [("abc ab", "x"), ("ab ab zz", "x"), ("qq", "y"), (None, "y"), ("zz", None)]
    got = language.profiles(spark.createDataFrame(rows, "text string, lang string"), 3).collect()
    want = Counter()
    for text, lang in rows:
        if lang == "x":
            want.update(slow_grams(text))
    top = sorted(want.items(), key=lambda kv: (-kv[1], [ord(c) for c in kv[0]]))
    assert len([r for r in got if r["lang"] == "x"]) == 3 and {r["rank"] for r in got} == {0, 1, 2}
    assert top[0][1] == max(want.values())
    with pytest.raises(ValueError):
        language.predict(spark.createDataFrame([(1, "a")], "doc_id long, text string"), [(f"l{i}", 1, 0) for i in range(1001)])
