"""Phrases against brute force in whole numbers, and on odd rows (the query's SQL covers the driver's tables)."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from epochal.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, n long, phrase string"


def brute(rows, longest=5, least=100, percent=100, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    candidates = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    covered = set()
    for k, a in candidates.items():
        for i in range(1, len(k)):
            for j in range(i + 2, len(k) + 1):
                inner = (k[0], *k[i:j])
                if len(inner) < len(k) and 100 * a >= percent * f[inner]:
                    covered.add(inner)
    out = []
    for k, a in candidates.items():
        cut = min((1000 * a * n[k[0]] // (f[k[:j]] * f[(k[0], *k[j:])]), j) for j in range(2, len(k)))
        if k not in covered:
            out.append((k[0], " ".join(k[1:]), a, f[k[: cut[1]]], f[(k[0], *k[cut[1] :])], n[k[0]], cut[0]))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    seen, ranked = Counter(), []
    for r in out:
        seen[r[0]] += 1
        if seen[r[0]] <= top:
            ranked.append((r[0], seen[r[0]], *r[1:]))
    return ranked


def found(spark, rows, **how):
    docs = spark.createDataFrame([(i, text, lang, i, "p") for i, (lang, text) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in collocations.collocations(docs, **how).collect())


def prose(seed, n, words=40):
    random = np.random.default_rng(seed)
    names = ["De", "en", "é", "von", "漢字", "x-y", *(f"w{k}" for k in range(words))]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!"]
    return "".join(names[k] + gaps[g] for k, g in zip(random.zipf(1.3, n) % len(names), random.integers(0, len(gaps), n)))


@pytest.mark.parametrize("how", [{"least": 5}, {"least": 8, "percent": 60}, {"least": 3, "longest": 3, "top": 7}, {"least": 2, "longest": 2}])
def test_equals_brute_force(spark, how):
    rows = [(("de", "en", None, "und", "x")[k % 5], prose(k, 150)) for k in range(40)]
    assert found(spark, rows, **how) == sorted(brute(rows, **how))


def test_repeats_overlap_and_ties(spark):
    rows = [("en", "a a a a a a b"), ("en", "A a A a a a b. c d"), ("de", "c d e, c d e"), ("de", "c d e f"), (None, "q r"), ("und", "q r")]
    want = brute(rows, least=2)
    assert found(spark, rows, least=2) == sorted(want) and any(r[2] == "q r" for r in want)


def test_odd_texts(spark):
    rows = [("en", None), ("en", ""), ("en", " . ; \t"), ("", "a b"), ("", "a b"), ("en", "one"), ("fr", "y z " * 60_000), ("fr", "\x1cy z\x00 y z"), (None, None)]
    assert found(spark, rows, least=2) == sorted(brute(rows, least=2))
    assert found(spark, [], least=1) == [] and found(spark, [("en", None)], least=1) == []


def test_a_word_named_like_a_language_keeps_its_own_count(spark):
    rows = [("de", "en x en x en x"), ("en", "de x de x")]
    assert found(spark, rows, least=2) == sorted(brute(rows, least=2))


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)
    rows = [("en", prose(k, 200)) for k in range(10)]
    assert found(spark, rows, least=4) == sorted(brute(rows, least=4))


def test_spelling():
    text = pa.array(["Ab  c\td. e f", "g h i j"])
    for data, starts, ends, of, words, left in collocations._words(text, np.zeros(2, np.uint64)):
        assert left.tolist() == [2, 1, 0, 1, 0, 3, 2, 1, 0] and of.tolist() == [0] * 5 + [1] * 4
        assert collocations._spelled(data, starts, ends, np.array([0, 5]), 3).to_pylist() == ["ab c d", "g h i"]
