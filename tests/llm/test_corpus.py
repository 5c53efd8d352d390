"""Operators with a second table, archives, and the pipeline."""

import base64
import gzip
import hashlib
import io
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lagsieve.llm import decontamination, ngram_jaccard, registry, runtime, toxicity, warc

from .common import empty, frame, got, in_order, texts
from .test_dedup import brute_components, shingle_set


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumns({"n": F.lit("x"), "value": F.lit("y")})


def brute_contained(rows, tests):
    best = {}
    for d, t in rows:
        x = shingle_set(t)
        for i, s in tests:
            y = shingle_set(s)
            if y and t is not None and s is not None and 100 * len(x & y) >= 75 * len(y):
                best[d, i] = max(best.get((d, i), (0, 0, 0)), (len(x & y) / len(y), len(y), len(x & y)))
    return [(d, i, n, k) for (d, i), (_, n, k) in best.items()]


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_ROWS, 0])
def test_decontamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
    docs = dict(texts())
    passage = docs[39]
    cut = " ".join(passage.split()[:40]).upper()
    tests = [(1, passage), (2, cut), (3, cut + " and then some words more than there were"), (4, "one"), (5, ""), (6, None), (7, "two words"), (8, docs[10]), (8, docs[10]), (8, passage), (9, "la " * 7)]
    out = decontamination.contained(frame(spark), items(spark, tests))
    assert got(out, "doc_id", "item_id", "n_item_shingles", "n_shared") == in_order(brute_contained(texts(), tests))


def test_decontamination_of_empty_tables(spark):
    one = items(spark, [(1, "a b c d e f")])
    assert decontamination.contained(empty(spark), one).count() == 0
    assert decontamination.contained(frame(spark), one.limit(0)).count() == 0


def labelled(n=400, seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeinorstlmd") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for d in range(n):
        ws = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        toxic = d % 4 == 0
        if toxic:
            for _ in range(max(2, len(ws) // 20)):
                ws[rng.randrange(len(ws))] = rng.choice(["vilefool", "vilefools", "Scumbag,", "idiotic"])
        rows.append((d, " ".join(ws)))
        labels.append((d, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark, monkeypatch):
    rows, labels = labelled()
    docs = frame(spark, rows + [(1000, None), (1001, ""), (1002, "123 !!"), (None, "you idiotic scumbag"), (1000, None)])
    known = spark.createDataFrame(labels + [(5000, 1), (None, 1), (7, None)], "doc_id long, toxic int").withColumn("quality", F.lit(1))
    out = toxicity.toxicity(docs, known)
    found = {r["doc_id"]: r for r in out.where("doc_id IS NOT NULL").collect()}
    truth = dict(labels)
    held = [r for d, r in found.items() if r["held_out"] and d in truth]
    right = [(r["score"] >= toxicity.THRESHOLD) == bool(truth[r["doc_id"]]) for r in held]
    assert len(held) > 80 and np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[1000]["score"] == found[1001]["score"] == found[1002]["score"] < 0.5
    assert out.count() == docs.count()
    monkeypatch.setattr(toxicity, "TABLE_ROWS", 0)  # the way for tables too large to broadcast
    joined = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, known).where("doc_id IS NOT NULL").collect()}
    assert all(abs(joined[d] - r["score"]) < 1e-9 for d, r in found.items())


def test_toxicity_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert len({r["score"] for r in toxicity.toxicity(frame(spark), none).collect()}) == 1
    assert toxicity.toxicity(empty(spark), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows, labels = labelled(120)
    from zlib import crc32

    docs = frame(spark, rows)
    flipped = [(d, 1 - y if crc32(str(d).encode()) % 3 == 1 else y) for d, y in labels]
    a, b = (got(toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")), "doc_id", "score") for x in (labels, flipped))
    assert a == b


PAGES = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (5, "http://a/5", "<p>same</p>"), (3, "http://b", ""), (4, None, None), (6, "http://c", "é" * 5000), (7, "x\r\ny", "\x1f\x8b\x08 not gzip"), (8, "u", "x" * 300_000), (None, "n", "<p>same</p>"), (9, "r", "twice"), (9, "r", "twice")]


def wanted_records(rows, least=0):
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        same = [q for q, _, g in rows if (g or "") == (h or "") and q is not None]
        top = max(same) if same else None
        revisit = top is not None and p != top and len(data) >= least
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return out


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("x"), "size": F.lit(1), "path": F.lit("y")}).repartition(3)


@pytest.mark.parametrize("step", [warc.RANGE_BYTES, 97])
@pytest.mark.parametrize("least", [0, 100])
def test_warc_round_trip(spark, step, least):
    manifest = warc.write_archives(pages(spark, PAGES), f"{runtime.shared_dir(spark)}/warc-{uuid.uuid4().hex}", least_bytes=least)
    out = warc.read_archives(manifest, range_bytes=step)
    assert got(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == in_order(wanted_records(PAGES, least))
    payloads = {(r["page_id"]): r["payload"] for r in out.where("record_type = 'response'").collect()}
    assert payloads[6] == bytearray(("é" * 5000).encode()) and payloads[4] == bytearray(b"")


def test_warc_files_are_plain_gzip_and_empty_tables_make_none(spark):
    folder = f"{runtime.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = warc.write_archives(pages(spark, PAGES), folder)
    text = b"".join(gzip.GzipFile(fileobj=io.BytesIO(warc.Source(r["path"], r["bytes"]).at(0, r["bytes"]))).read() for r in manifest.collect())
    assert text.count(b"WARC/1.1\r\n") == len(PAGES) and b"WARC-Type: revisit" in text
    nothing = warc.write_archives(pages(spark, PAGES).limit(0), f"{folder}-0")
    assert warc.read_archives(nothing).count() == 0


def test_magic_inside_a_payload_is_no_record(tmp_path):
    inner = warc.member(warc.record(1, "u", b"inner", "D", None, 5))
    noise = np.random.default_rng(0).bytes(3000)
    rows = [warc.member(warc.record(k, "u", noise + b"\x1f\x8b\x08" + inner[:20] + noise, base64.b32encode(hashlib.sha1(noise + b"\x1f\x8b\x08" + inner[:20] + noise).digest()).decode(), None, 0)) for k in range(3)]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(rows))
    size = path.stat().st_size
    for step in (1, 50, 999, size):
        ids = [r[0] for s in range(0, size, step) for r in warc.records_of(str(path), size, s, min(s + step, size))] if step > 1 else [0, 1, 2]
        assert ids == [0, 1, 2]


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "secret_scan", "packing"]
    docs = runtime.table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if name != "packing" else before
        docs = runtime.written(stage(spark, docs, sf), f"test-{name}")
        if name == "packing":
            assert {r["doc_id"] for r in docs.collect()} == set(before)
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "ngram_jaccard":
            assert set(after) == {d for d, _, c in brute_components(list(before.items())) if d == c}
        if name == "decontamination":
            tests = [(r["item_id"], r["text"]) for r in runtime.table(spark, sf, "benchmark").collect()]
            assert set(before) - set(after) == {d for d, *_ in brute_contained(list(before.items()), tests)}
        if name == "secret_scan":
            assert set(before) == set(after) and all(corpus_pipeline.REDACTED in t for d, t in after.items() if t != before[d])
        if name == "toxicity":
            assert set(after) <= set(before)


def test_pipeline_keeps_odd_rows(spark):
    docs = frame(spark, [(1, None), (2, ""), (None, "a b c"), (3, "plain words here")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = runtime.written(stage(spark, docs, "/root/testdata/sf0.001"), f"odd-{name}")
        assert docs.count() == 4, name
    assert ngram_jaccard.jaccard_components(docs).count() == 4


def test_pipeline_loses_no_text_of_a_repeated_id(spark):
    rows = [(46, "one wholly different text of its own kind"), (46, "and another text under the very same number"), (46, "and another text under the very same number"), (5, None), (5, ""), (47, "and another text under the very same number")]
    out = corpus_pipeline.ngram_jaccard_stage(spark, frame(spark, rows), "")
    assert got(out, "doc_id", "text") == in_order([rows[0], rows[1], rows[3], rows[4]])


def test_pipeline_of_an_empty_table_and_of_clashing_names(spark):
    sf = "/root/testdata/sf0.001"
    none, odd = empty(spark), frame(spark, [(1, "plain words stand here"), (2, "x" * 3_000_000 + " " + "some words " * 200_000), (3, 'password = "hunter2hunter2"')])
    for c in ("_gone", "_again", "_leaked", "score", "held_out", "x0", "_row", "_t1", "c_t1"):
        none, odd = none.withColumn(c, F.lit(1)), odd.withColumn(c, F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = odd.columns
        none, odd = (runtime.written(stage(spark, x, sf), f"clash-{name}") for x in (none, odd))
        assert none.count() == 0 and none.columns == odd.columns == columns
        assert [r["doc_id"] for r in odd.select("doc_id").orderBy("doc_id").collect()] == [1, 2, 3], name
    assert corpus_pipeline.REDACTED in odd.where("doc_id = 3").first()["text"]
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, none, sf).count() == 0
    packed = {r["doc_id"]: r["n"] for r in stage(spark, odd, sf).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()}
    assert set(packed) == {1, 2, 3} and packed[2] > 400_000


def test_pipeline_rejects_what_the_models_reject(spark, tmp_path):
    rows, labels = labelled(240)
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = frame(spark, rows)
    kept = {r["doc_id"] for r in corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path)).collect()}
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert kept == {d for d, s in scores.items() if s < toxicity.THRESHOLD} and 0 < len(kept) < len(rows)


def test_written_tables_can_be_swept(spark):
    a, b = runtime.written(spark.range(3), "a"), runtime.written(spark.range(4), "b")
    runtime.sweep(spark, keep=b)
    assert b.count() == 4
    with pytest.raises(Exception):  # noqa: B017
        a.count()


def test_registry_names():
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)


def test_pipeline_drops_leaked_rows_without_an_id(spark, tmp_path):
    passage = dict(texts())[39]
    items(spark, [(1, passage)]).write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, f"before {passage} after"), (None, "clean and without any id at all"), (None, None), (1, passage), (2, "clean with an id of its own")]
    out = corpus_pipeline.decontamination_stage(spark, frame(spark, rows), str(tmp_path))
    assert got(out, "doc_id", "text") == in_order([rows[1], rows[2], rows[4]])
    assert out.columns == frame(spark, rows).columns


def test_a_text_goes_to_the_workers_once_a_stage(spark, monkeypatch):
    """A second copy of each text beside it took the executors of the redacting stage beyond their memory."""
    docs, sent, real = frame(spark, [(1, "password = hunter2hunter2"), (2, "plain words")]), [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *rest: sent.append((self, schema)) or real(self, f, schema, *rest))
    for stage in (corpus_pipeline.toxicity_stage, corpus_pipeline.secret_scan_stage):
        sent.clear()
        out = stage(spark, docs, "/root/testdata/sf0.001")
        rows, schema = sent[-1]
        assert [list(r).count("plain words") for r in rows.collect() if r["doc_id"] == 2] == [1], stage
        assert out.columns == docs.columns and dict(got(out, "doc_id", "text"))[2] == "plain words"


def test_a_worker_forgets_what_other_operators_left():
    runtime.powers(7, 100)
    runtime.worker_state("mine")["x"] = 1
    tables = runtime.worker_state("tables")
    runtime.fresh("mine")
    assert runtime.worker_state("mine") == {"x": 1} and runtime.worker_state("tables") is tables and 7 not in runtime.worker_state("powers")
