"""The toxicity models against a plain implementation."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from lagsieve.llm import toxicity

from .test_corpus import labelled

D, S, d = toxicity.DISCOUNT, toxicity.STRENGTH, toxicity.SHARED_DISCOUNT


def plain_words(text):
    letters = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in (text or "").encode())
    return [w + b" " for w in re.findall(rb"[^ ]+", letters)]


class Plain:
    """Both classes' Kneser-Ney models, from dictionaries."""

    def __init__(self, rows):
        self.n = [Counter(), Counter()]
        for text, toxic in rows:
            for w in plain_words(text):
                for k in range(len(w)):
                    self.n[toxic][w[:k], w[k]] += 1
        seen = set(self.n[0]) | set(self.n[1])
        self.total = [Counter(), Counter()]
        self.kept = [Counter(), Counter()]
        for c in (0, 1):
            for (h, _), n in self.n[c].items():
                self.total[c][h] += n
                self.kept[c][h] += min(n, D)
        self.kinds = Counter(h for h, _ in seen)
        self.grams = Counter((h[-2:], x) for h, x in seen)
        self.gram_total, self.gram_kinds = Counter(), Counter()
        self.symbol = Counter()
        for (g, x), n in self.grams.items():
            self.gram_total[g] += n
            self.gram_kinds[g] += 1
            self.symbol[x] += 1
        self.symbols = sum(self.symbol.values())

    def shared(self, h, x):
        one = (max(self.symbol[x] - d, 0) + d * len(self.symbol) / 256) / self.symbols
        g = h[-2:]
        two = (max(self.grams[g, x] - d, 0) + d * self.gram_kinds[g] * one) / self.gram_total[g] if self.gram_total[g] else one
        n, total = self.n[0][h, x] + self.n[1][h, x], self.total[0][h] + self.total[1][h]
        return (max(n - d, 0) + d * self.kinds[h] * two) / total if total else two

    def ratio(self, w):
        p = [[], []]
        for k in range(len(w)):
            h, x = w[:k], w[k]
            for c in (0, 1):
                p[c].append(math.log((max(self.n[c][h, x] - D, 0) + (S + self.kept[c][h]) * self.shared(h, x)) / (self.total[c][h] + S)))
        return sum(p[1]) - sum(p[0])

    def statistic(self, text):
        words = plain_words(text)
        return sum(math.log(1 - toxicity.MIX + toxicity.MIX * math.exp(self.ratio(w))) for w in words) / (len(words) + toxicity.SMOOTH_WORDS)


@pytest.mark.parametrize("limit", [toxicity.TABLE_ROWS, 0])
def test_models_equal_a_plain_implementation(spark, monkeypatch, limit):
    monkeypatch.setattr(toxicity, "TABLE_ROWS", limit)
    rows, labels = labelled(150)
    rows += [(200, "é ß 漢字 ü 😀 Ünder"), (201, "aaaa" * 2000 + " " + "aaaa" * 1999), (202, "internationals internationally internationals")]
    truth = dict(labels) | {200: 1, 201: 0, 202: 1}
    learn = spark.createDataFrame([(t, truth[i], i % 2) for i, t in rows], "text string, toxic int, fold int").repartition(3)
    tables = toxicity.compile_tables(toxicity.count(learn))
    asked = rows + [(300, ""), (301, None), (302, "unknown wörds and vilefoolish ones, aaaa"), (303, "scum " * 300_000)]
    docs = spark.createDataFrame(asked, "doc_id long, text string").repartition(2).select("doc_id", "text")
    got = {r["doc_id"]: r for r in toxicity.statistics(docs, tables).collect()}
    assert len(got) == len(asked)
    for v, part in enumerate((rows, rows[0::2], rows[1::2])):
        part = rows if v == 0 else [r for r in rows if r[0] % 2 == v - 1]
        model = Plain([(t, truth[i]) for i, t in part])
        cache: dict = {}
        plain, model.ratio = model.ratio, lambda w: cache.setdefault(w, plain(w)) if w not in cache else cache[w]
        for i, t in asked:
            if t is None or len(t) < 10_000:  # slow for the long words, which are compared below
                assert got[i][f"x{v}"] == pytest.approx(model.statistic(t), abs=1e-9), (v, i)
        long = plain_words(asked[-1][1])
        assert got[303][f"x{v}"] == pytest.approx(len(long) * math.log(1 - toxicity.MIX + toxicity.MIX * math.exp(model.ratio(long[0]))) / (len(long) + toxicity.SMOOTH_WORDS), abs=1e-9)


def test_probabilities_add_up():
    rows, labels = labelled(60)
    model = Plain([(t, dict(labels)[i]) for i, t in rows])
    for h in (b"", b"a", b"vil", b"sc"):
        assert sum(model.shared(h, x) for x in range(256)) == pytest.approx(1 if sum(t[h] for t in model.total) else sum(model.shared(h, x) for x in range(256)))


def test_words_alike_at_their_beginnings_are_told_apart(spark):
    learn = spark.createDataFrame([("abcdefghX plain text here", 1, 0), ("abcdefghY plain text here", 0, 0)] * 20, "text string, toxic int, fold int")
    table = toxicity.compile_tables(toxicity.count(learn))[:1]
    docs = spark.createDataFrame([(1, "abcdefghX"), (2, "abcdefghY")], "doc_id long, text string")
    got = {r["doc_id"]: r["x0"] for r in toxicity.statistics(docs, table).collect()}
    assert got[1] > 0 > got[2]


def test_curve_is_isotonic_and_flat_without_both_classes():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    y = (x + rng.normal(size=500) > 0).astype(float)
    at, scores = toxicity.fit_curve(np.round(x, 1), y)
    assert (np.diff(at) > 0).all() and (np.diff(scores) > 0).all() and 0 <= scores[0] and scores[-1] <= 1
    for flat in (np.zeros(3), np.ones(3), np.zeros(0)):
        assert len(toxicity.fit_curve(np.arange(len(flat), dtype=float), flat)[1]) == 1
