"""Corpus order by dictionary and parse against plain sorting; fingerprints whose halves clash."""

import numpy as np
import pytest

from lagsieve.llm import runtime, suffix_dedup, suffix_order

from .common import frame, got, in_order
from .test_dedup import brute_bytes


def lcp(a, b):
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


@pytest.mark.parametrize("kind", ["repeats", "letters", "runs", "bytes"])
@pytest.mark.parametrize("length", [20, 45])
def test_corpus_order(kind, length):
    rng = np.random.default_rng(len(kind) + length)
    for _ in range(40):
        if kind == "repeats":
            base = rng.integers(97, 100, 150).astype(np.uint8)
            texts = [base[rng.integers(0, 40) : rng.integers(90, 150)] for _ in range(6)]
        elif kind == "letters":
            texts = [rng.integers(97, 99, rng.integers(length, 200)).astype(np.uint8) for _ in range(5)]
        elif kind == "runs":
            texts = [np.concatenate([np.full(rng.integers(0, 90), 97), rng.integers(97, 99, 3), np.full(rng.integers(length, 90), 97)]).astype(np.uint8) for _ in range(5)]
        else:
            base = rng.integers(0, 3, 120).astype(np.uint8) * 127
            texts = [np.concatenate([base[: rng.integers(60, 120)], rng.integers(0, 256, rng.integers(0, 30)).astype(np.uint8)]) for _ in range(6)]
        w = 4
        data = np.concatenate(texts)
        last = np.cumsum([len(t) for t in texts])
        first = last - [len(t) for t in texts]
        # triggers depend on w bytes alone
        every = np.array([p for a, b in zip(first, last) for p in range(a, b - w + 1) if int(data[p : p + w].astype(int) @ [3, 5, 7, 11]) % 7 == 0], np.int64)
        at = np.array([p for a, b in zip(first, last) for p in range(a, b - length + 1)], np.int64)
        got_ = suffix_order.CorpusOrder(data, (first, last), every, w, at, length)
        suffix = [data[p : last[np.searchsorted(last, p, side="right")]].tobytes() for p in at]
        strings = [x[:length] for x in suffix]
        group = got_.groups()
        assert len(set(zip(group, strings))) == len(set(group)) == len(set(strings))
        # as far as `length` bytes tell, the order is that of the bytes, and common prefixes are theirs
        in_corpus_order = [strings[i] for i in got_.order]
        assert in_corpus_order == sorted(strings)
        common = got_.common()
        for k, (i, j) in enumerate(zip(got_.order[:-1], got_.order[1:])):
            if not got_.equal[k]:
                assert common[k] == lcp(suffix[i], suffix[j])


def test_corpus_order_of_nothing():
    none = np.zeros(0, np.int64)
    assert len(suffix_order.CorpusOrder(np.zeros(0, np.uint8), (none, none), none, 8, none, 400).groups()) == 0


def test_regions_of_nothing_in_common():
    data = np.frombuffer(b"abcdefghijklmnop", np.uint8)
    order = suffix_order.CorpusOrder(data, (np.array([0, 8]), np.array([8, 16])), np.array([3, 11]), 2, np.array([0, 1, 8, 9]), 6)
    assert len(set(order.groups())) == 4


def test_pairs_with_equal_first_halves():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 300).astype(np.uint64), rng.integers(0, 7, 300).astype(np.uint64)
    pairs = runtime.Pairs(a, b)
    one, inverse, count = pairs.distinct()
    assert len(one) == len(set(zip(a.tolist(), b.tolist()))) and count.sum() == 300
    assert (a[one][inverse] == a).all() and (b[one][inverse] == b).all()
    known = pairs.take(one[::2])
    found = known.find(pairs)
    assert ((found >= 0) == (inverse % 2 == 0)).all() and (known.a[found[found >= 0]] == a[found >= 0]).all()


def test_suffix_dedup_with_clashing_first_hashes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = "".join(rng.choice(list("abcdef "), 1500))
    rows = [(1, base), (2, base[:700] + "zz" + base[900:]), (3, base[300:1200]), (4, "".join(rng.choice(list("abcdef "), 900)))]
    plain = suffix_dedup.Parsed.hashes

    def weak(self, starts, lengths):
        pairs = plain(self, starts, lengths)
        return runtime.Pairs(pairs.a & np.uint64(3), pairs.b)

    monkeypatch.setattr(suffix_dedup.Parsed, "hashes", weak)
    out = suffix_dedup.remove_repeats(frame(spark, rows))
    assert got(out, "doc_id", "n_removed") == [(r[0], r[2]) for r in in_order(brute_bytes(rows, 400))]
