"""Substring, suffix and Jaccard operators against their definitions."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagsieve.llm import components, ngram_jaccard, runtime, substring_dedup, suffix_dedup

from .common import empty, frame, got, in_order, texts, words


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def brute_words(rows, w=13):
    first = {}
    order = lambda d: (1 << 63) - 1 if d is None else d
    for d, t in rows:
        ws = words(t)
        for i in range(len(ws) - w + 1):
            key = tuple(ws[i : i + w])
            first[key] = min(first.get(key, order(d)), order(d))
    out = []
    for d, t in rows:
        ws = words(t)
        gone = set()
        for i in range(len(ws) - w + 1):
            if first[tuple(ws[i : i + w])] < order(d):
                gone.update(range(i, i + w))
        out.append((d, len(ws), len(gone), sha(" ".join(x for i, x in enumerate(ws) if i not in gone))))
    return out


def test_substring_dedup(spark):
    out = substring_dedup.remove_repeats(frame(spark)).withColumn("kept_sha256", F.sha2("kept", 256))
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == in_order(brute_words(texts()))
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def brute_bytes(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, data):
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        runs = sum(covered[i] and not (i and covered[i - 1]) for i in range(len(t)))
        out.append((d, len(t), sum(covered), runs, sha(bytes(b for b, c in zip(t, covered) if not c))))
    return out


@pytest.mark.parametrize("length", [400, 300])
def test_suffix_dedup(spark, length):
    out = suffix_dedup.remove_repeats(frame(spark), length=length).withColumns({"n_spans": F.size("removed"), "kept_sha256": F.sha2("kept", 256)})
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == in_order(brute_bytes(texts(), length))


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(empty(spark), length=100)


def test_suffix_dedup_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 2000)
    rng = np.random.default_rng(3)
    long = "".join(rng.choice(list("abcdefgh "), 30_000))
    rows = [(1, long), (2, long[9_000:12_000]), (3, "q" * 5000), (4, long[100:499]), (5, long[20_000:20_400])]
    out = suffix_dedup.remove_repeats(frame(spark, rows)).withColumn("n_spans", F.size("removed"))
    assert got(out, "doc_id", "n_removed", "n_spans") == [r[:1] + r[2:4] for r in in_order(brute_bytes(rows, 400))]


def shingle_set(text):
    ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute_components(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    forest = components.Forest()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                forest.join(a, b)
    return [(d, len(s), None if d is None else forest.find(d)) for d, s in sets]


def near_copies(seed, families=8, size=12):
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(families):
        ws = [f"w{x}" for x in rng.integers(0, 60 if f % 2 else 10_000, 80)]
        for _ in range(size):
            own = list(ws)
            for at in rng.integers(0, len(ws), rng.integers(0, 7)):
                own[at] = f"c{rng.integers(0, 5)}"
            rows.append((len(rows) * 3 % 101 + 1000 * f, " ".join(own[: rng.integers(60, 81)])))
    return rows


def test_jaccard_components(spark):
    out = ngram_jaccard.jaccard_components(frame(spark))
    assert got(out, "doc_id", "n_shingles", "component_id") == in_order(brute_components(texts()))
    assert ngram_jaccard.jaccard_components(empty(spark)).count() == 0


@pytest.mark.parametrize("limit", [(ngram_jaccard.PART_SHINGLES, ngram_jaccard.BLOCK_SHINGLES), (300, 300), (200, ngram_jaccard.BLOCK_SHINGLES)])
def test_jaccard_near_copies_in_whole_and_split_blocks(spark, monkeypatch, limit):
    monkeypatch.setattr(ngram_jaccard, "PART_SHINGLES", limit[0])
    monkeypatch.setattr(ngram_jaccard, "BLOCK_SHINGLES", limit[1])
    rows = near_copies(1)
    out = ngram_jaccard.jaccard_components(frame(spark, rows))
    assert got(out, "doc_id", "n_shingles", "component_id") == in_order(brute_components(rows))


def test_tree_finds_a_link_if_there_is_one():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sets = [np.unique(rng.integers(0, 25, rng.integers(1, 22)).astype(np.uint64)) for _ in range(12)]
        tree = ngram_jaccard.Tree()
        for i, s in enumerate(sets[:-1]):
            tree.add(s, len(s), i)
        probe = sets[-1]
        linked = {i for i, s in enumerate(sets[:-1]) if 100 * len(np.intersect1d(s, probe)) >= 75 * len(np.union1d(s, probe))}
        found = tree.link(probe, len(probe), 75)
        assert (found in linked) if linked else found is None


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 300), (300, 250), (250, 200)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert dict(got(components.components(df), "id", "component")) == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(40)}, 200: 200, 250: 200, 300: 200}
    assert components.components(df.limit(0)).count() == 0


def test_hashes_tell_stretches_apart():
    values = runtime.byte_values(7)[np.frombuffer(b"abcabcabd", np.uint8)]
    rolling = runtime.Rolling(values, 7)
    a, b, c = rolling.of(np.array([0, 3, 6]), 3)
    assert a == b != c and (rolling.windows(3)[[0, 3, 6]] == [a, b, c]).all()


def test_jaccard_of_chains_that_parts_break(spark, monkeypatch):
    """Sets that link only to their neighbours in a chain, so that no part and no representative sees the whole."""
    monkeypatch.setattr(ngram_jaccard, "PART_SHINGLES", 400)
    ws = [f"w{i}" for i in range(400)]
    rows = [(1000 - i, " ".join(ws[5 * i : 5 * i + 60])) for i in range(60)] + [(5, "common " * 3 + " ".join(ws[:5])), (6, " ".join(f"x{i}" for i in range(30)))]
    out = ngram_jaccard.jaccard_components(frame(spark, rows))
    wanted = in_order(brute_components(rows))
    assert len({c for _, _, c in wanted}) == 3 and got(out, "doc_id", "n_shingles", "component_id") == wanted


def test_jaccard_of_ids_with_several_texts(spark):
    rng = np.random.default_rng(2)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10_000, n))
    a, b, c = say(40), say(40), say(40)
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [(46, a), (46, b), (90, near(a)), (91, near(b)), (46, a), (50, c), (12, c), (50, near(a)), (7, say(30)), (7, None), (99, near(c)), (None, a)]
    out = ngram_jaccard.jaccard_components(frame(spark, rows))
    assert got(out, "doc_id", "n_shingles", "component_id") == in_order([(d, len(shingle_set(t)), None if d is None else 7 if d == 7 else 12) for d, t in rows])
