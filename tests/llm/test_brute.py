"""Whole results of queries that SQL can't express, held against slow models of them."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
import xxhash

from quantavol.llm import language, mixing, quality, sharding
from test_quality_language import counts, slow_grams
from test_sharding_mixing import slow_jump

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ratios(text):
    text = text or ""
    n_words, chars, symbols, dup, repeat = counts(text)
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    share = lambda a, b: a / b if b else 0.0
    ascii_ = [c for c in text if ord(c) < 128]
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat,
        "chars_a_word": share(chars, n_words), "symbol_share": share(symbols, chars), "dup_line_share": share(dup, len(lines)),
        "repeat_share": share(repeat, n_words), "upper_share": share(sum("A" <= c <= "Z" for c in text), chars),
        "digit_share": share(sum("0" <= c <= "9" for c in text), chars), "punct_share": share(sum(33 <= ord(c) < 127 and not c.isalnum() for c in ascii_), chars),
        "lone_share": share(sum(len(w.encode()) == 1 for w in words), n_words), "words_a_line": share(n_words, len(lines)),
        "distinct_share": share(len(set(words)), n_words), "longest_word": max((len(w.encode()) for w in words), default=0),
    }


def test_verdicts_of_the_list(spark, docs, corpus):
    """Every row's verdict is that of the rules, taken one by one over slow statistics."""
    facts = {i: ratios(text) for i, text, *_ in corpus}
    labels = spark.createDataFrame([(i, int(f["words_a_line"] > 40 or f["chars_a_word"] > 4.3)) for i, f in facts.items()], "doc_id long, quality int")
    out, rules = quality.judge(spark, docs, labels, min_cover=2, min_precision=0.6)
    assert rules.rules
    for r in out.collect():
        f = facts[r["doc_id"]]
        rejected = any(all((f[c.column] > c.limit) if c.above else (f[c.column] <= c.limit) for c in rule) for rule in rules.rules)
        failed = f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"]
        assert (r["base_failed"], r["kept"]) == (failed, not failed and not rejected), r


def test_shards_and_slots(spark, docs, corpus):
    rows = sorted(sharding.place_documents(spark, docs).collect(), key=lambda r: r["doc_id"])
    slot = Counter()
    for r, (i, text, *_) in zip(rows, sorted(corpus)):
        key = xxhash.xxh64(i.to_bytes(8, "little"), seed=42).intdigest()
        raw, shard = (text or "").encode(), slow_jump(key, 8)
        assert tuple(r) == (i, len(raw) + 1, zlib.crc32(raw), "key", shard, slot[shard], slow_jump(key, 9))
        slot[shard] += 1


def test_out_of_place_distance(spark, corpus):
    """Profiles and distances by counting n-grams of strings; a profile shorter than texts have n-grams."""
    size, rows = 120, [(i, text, lang) for i, text, lang, _ in corpus]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    number = lambda g: [len(g), *(0 if c == " " else ord(c) for c in g)]
    ranked = lambda n: [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], number(x[0])))[:size]]
    totals: dict[str, Counter] = {}
    for i, text, lang in rows:
        if text is not None and lang is not None and not held(i):
            totals.setdefault(lang, Counter()).update(slow_grams(text))
    profiles = {lang: {g: k for k, g in enumerate(ranked(n))} for lang, n in totals.items()}
    got = {r["doc_id"]: r for r in language.identify(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), size).collect()}
    for i, text, _ in rows:
        r = got[i]
        assert r["held_out"] == held(i)
        if not re.search(r"[^\W\d_]", text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        grams = ranked(slow_grams(text))
        distance = {lang: sum(abs(p[g] - k) if g in p else size for k, g in enumerate(grams)) for lang, p in profiles.items()}
        first, second, *_ = sorted(distance.items(), key=lambda x: (x[1], x[0]))
        worst = size * len(grams)
        assert r["lang_pred"] == first[0], i
        assert r["score"] == pytest.approx(0.5 * (1 - first[1] / worst) + 0.5 * (1 - first[1] / min(second[1], worst) if second[1] else 0)), i


def slow_mix(rows, weights=(5, 2, 1), most=3):
    """taken words of documents (doc_id, size, source), each belonging to one source."""
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    sizes = [sum(n for _, n, s in rows if s == name) for name in names]
    targets = mixing.capped_targets(sizes, [weights[k % 3] for k in range(len(names))], most)
    out = {}
    for name, size, target in zip(names, sizes, targets):
        mine = sorted((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i, n) for i, n, s in rows if s == name)
        whole, gap = divmod(round(target), size) if size else (0, 0)
        extra = set()
        for _ in range(mixing.ROUNDS):
            fits, total = gap, 0
            for x in mine:
                if x in extra or not 0 < x[2] <= fits:
                    continue
                if total + x[2] > gap:
                    break
                total += x[2]
                extra.add(x)
            gap -= total
        near = [(abs(x[2] - gap), x) for x in mine if x not in extra and abs(x[2] - gap) < gap]
        extra |= {min(near)[1]} if near else set()
        out |= {x[1]: min(most, whole + (x in extra)) * x[2] for x in mine}
    return out


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_selection_of_the_mix(spark, docs, corpus, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_PATTERNS", broadcast)
    rows = [(i, len(WORD.findall(text or "")), source) for i, text, _, source in corpus]
    assert {r["doc_id"]: r["taken"] for r in mixing.mix_documents(spark, docs).collect()} == slow_mix(rows)
