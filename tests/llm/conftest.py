import random

import pytest

LANGS = {"en": "the of and to in a is that for it was on are with as".split(), "fr": "le la les des une est dans pour que qui été où à ça".split(), "de": "der die das und ist nicht für über straße mit ein zu von".split()}


def words(rng: random.Random, n: int, lang: str = "en") -> list[str]:
    return [rng.choice(LANGS[lang]) + rng.choice(["", "", "x", "ing", "er"]) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """(doc_id, text, lang, source): copies, near copies, shared passages, odd and missing values."""
    rng = random.Random(5)
    out, passage = [], " ".join(words(rng, 40))
    for i in range(90):
        lang = rng.choice(list(LANGS))
        body = words(rng, rng.choice([3, 12, 60, 150, 300]), lang)
        text = " ".join(body[: len(body) // 2]) + "\n" + " ".join(body[len(body) // 2 :])
        if i % 9 == 0:
            text = text + " " + passage + "\n" + text[:40]
        out.append((i, text, lang, rng.choice(["a", "b", "b", "b", "é", None])))
    for i in range(90, 120):
        base = out[(i * 7) % 60][1].split(" ")
        if i % 3:
            base[len(base) // 2] = "changed"
        out.append((i, " ".join(base), "en", "b"))
    out += [(120, None, None, None), (121, "", "en", "a"), (122, " \t\n\x0b ", "fr", "a"), (123, "One", "en", "a"), (124, "A b c", "de", "é"), (125, "12 34 ## <<>>", None, "b")]
    out += [(126, " ".join(words(rng, 9000)), "en", "b"), (127, "same line\nsame line\n same line\nsame line", "en", "b"), (128, passage, "fr", "b"), (129, "same same " * 60, "fr", "b")]
    return out


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with one more column whose name clashes with those operators use."""
    rows = [(*r, "x", 1, 2) for r in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, node string, size int, part int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
