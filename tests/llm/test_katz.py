import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from quantavol.llm import katz

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), "</s>"]


class Slow:
    """The model by its definition, with dictionaries."""

    def __init__(self, texts, order=2):
        self.order, self.n = order, [Counter() for _ in range(order)]
        for x in texts:
            row = ["<s>"] * (order - 1) + tokens(x)
            for k in range(order - 1, len(row)):
                for n in range(order):
                    self.n[n][tuple(row[k - n : k + 1])] += 1
        cc = lambda c: [0, *(sum(1 for v in c.values() if v == r) for r in range(1, katz.SMALL + 2))]
        self.uni = Counter({g[0]: c for g, c in self.n[0].items()})
        self.d = katz.discounts(cc(self.uni), sum(self.uni.values()), len(self.uni))
        self.f = [katz.good_turing(cc(c)) for c in self.n]
        self.after = defaultdict(dict)
        for c in self.n[1:]:
            for g, m in c.items():
                self.after[g[:-1]][g[-1]] = m

    def cut(self, n, f):
        return n * (f[n] if n <= katz.SMALL else 1.0)

    def prob(self, history, w):
        if not history:
            return self.cut(self.uni[w], self.f[0]) / self.d.den if w in self.uni else self.d.unknown
        seen = self.after.get(history)
        if not seen:
            return self.prob(history[1:], w)
        total, f = sum(seen.values()), self.f[len(history)]
        mass = sum(self.cut(n, f) for n in seen.values())
        den = total if mass < total - 1e-12 else total + 1
        if w in seen:
            return self.cut(seen[w], f) / den
        return (1 - mass / den) / (1 - sum(self.prob(history[1:], x) for x in seen)) * self.prob(history[1:], w)

    def score(self, text):
        row, k = ["<s>"] * (self.order - 1) + tokens(text), self.order - 1
        return sum(math.log10(self.prob(tuple(row[i - k : i]), row[i])) for i in range(k, len(row)))


@pytest.fixture(scope="module", params=[2, 3, 4])
def slow(corpus, request):
    return Slow([r[1] for r in corpus if zlib.crc32(str(r[0]).encode()) % 5 != 1], request.param)


def test_equals_definition(spark, docs, corpus, slow, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_BYTES", 5000)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = {r["doc_id"]: r for r in katz.score_documents(spark, docs, held, slow.order).collect()}
    assert len(got) == len(corpus)
    n, v = sum(slow.uni.values()), len(slow.uni)
    for i, text, *_ in corpus:
        w = tokens(text)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in slow.uni for x in w), n)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert r["base_score"] == pytest.approx(sum(math.log10((slow.uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r["score"] == pytest.approx(slow.score(text))


def test_stored_tables_score_other_texts(spark, docs, corpus, slow, monkeypatch):
    """A model kept in its tables gives the same scores as the query that trained it."""
    monkeypatch.setattr(katz, "BLOCK_BYTES", 5000)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    model = katz.train(spark, docs.filter(~held), slow.order)
    assert {tuple(r) for r in model.tables.select("order", "kind").distinct().collect()} == {(n, k) for n in range(2, slow.order + 1) for k in (katz.COUNTS, katz.TABLE)}
    others = spark.createDataFrame([(1, "a word never seen"), (2, None), (None, "the of and to"), (-(2**63), "zz")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in model.score(spark, docs.select("doc_id", "text").unionAll(others.filter("doc_id < 0"))).collect()}
    assert got == {i: pytest.approx(slow.score(x)) for i, x in [*((r[0], r[1]) for r in corpus), (-(2**63), "zz")]}
    assert {r["doc_id"]: r["score"] for r in model.score(spark, others).collect()} == {r[0]: pytest.approx(slow.score(r[1])) for r in others.collect()}
    assert katz.train(spark, docs.limit(0)) is None


def test_every_distribution_sums_to_one(slow):
    for history in [(), *list(slow.after)[:40], *list(slow.after)[-40:], ("never",) * (slow.order - 1)]:
        assert sum(slow.prob(history, w) for w in slow.uni) + slow.prob(history, "<unk>") == pytest.approx(1)


def test_empty_and_untrained(spark, no_docs):
    assert katz.score_documents(spark, no_docs, F.lit(False)).count() == 0
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in katz.score_documents(spark, df, F.lit(True)).collect()}
    assert got[1]["n_tokens"] == 3 and got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0 and got[1]["score"] == 0.0
    assert got[None]["n_tokens"] == 1
