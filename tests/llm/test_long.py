"""Texts of several megabytes: worked on whole, with the same results as their definitions give."""

import random
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagsieve.llm import decontamination, ngram_jaccard, packing, quality_rules, runtime, secret_scan, substring_dedup, token_counts, toxicity, warc

from .common import frame, got, in_order
from .test_corpus import brute_contained, items, labelled, pages, wanted_records
from .test_dedup import brute_components, brute_words
from .test_rowwise import brute_quality, brute_spans

END = "at the very end stands a passage of some twenty words that no other part of the long text holds but this"


@pytest.fixture(scope="module")
def rows():
    """A text of 2.5 MB, a near copy of it, one long word, and a short text that repeats the end of the first."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    ws = rng.choices(vocabulary, k=400_000)
    near = list(ws)
    near[5000::20_000] = ["changed"] * len(near[5000::20_000])
    long = f"{' '.join(ws)} password=hunter22hunter {END}"
    return [(1, long), (2, " ".join(near)), (3, "ab" * 1_000_000), (4, f"before {END} after"), (5, "x " * 500_000)]


def test_token_counts(spark, rows):
    from tokenizers import Tokenizer, models, pre_tokenizers

    library = Tokenizer(models.Unigram(token_counts.pieces_of(runtime.vocabulary("piece_bpe_32k.model")), unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    wanted = [(d, len(library.encode(t, add_special_tokens=False).ids)) for d, t in rows]
    assert got(token_counts.count_tokens(frame(spark, rows)), "doc_id", "n_tokens") == wanted


def test_quality(spark, rows):
    out = quality_rules.quality(frame(spark, rows))
    assert got(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == [(d, *brute_quality(t)) for d, t in rows]


def test_decontamination(spark, rows):
    tests = [(1, END), (2, "nothing of this stands in any of the long texts at all")]
    out = decontamination.contained(frame(spark, rows), items(spark, tests))
    found = got(out, "doc_id", "item_id", "n_item_shingles", "n_shared")
    assert found == in_order(brute_contained(rows, tests)) and [f[:2] for f in found] == [(1, 1), (4, 1)]


def test_secrets(spark, rows):
    out = secret_scan.scan(frame(spark, rows)).withColumn("s", F.expr(secret_scan.joined("spans", secret_scan.KINDS[:3])))
    assert got(out, "doc_id", "s") == [(d, brute_spans(t)) for d, t in rows]


def test_packing(spark, rows):
    library = packing.WordTokenizer(runtime.vocabulary("word_bpe_49k.json")).tokenizer
    some = rows[:2] + rows[3:]
    pieces = {d: {} for d, _ in some}
    for r in packing.pack(frame(spark, some)).collect():
        pieces[r["doc_id"]][r["start"]] = bytes(r["ids"])
    for d, t in some:
        whole = np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes()
        assert zlib.crc32(b"".join(pieces[d][s] for s in sorted(pieces[d]))) == zlib.crc32(whole)


def test_toxicity(spark):
    docs, labels = labelled()
    ordinary = " ".join(t for d, t in docs if d % 4)
    toxic = " ".join(t for d, t in docs if d % 4 == 0)
    long = [(9001, ordinary * 20), (9002, toxic * 60)]
    table = spark.createDataFrame([(d, 1, x) for d, x in labels], "doc_id long, quality int, toxic int")
    score = dict(got(toxicity.toxicity(frame(spark, docs + long), table).where("doc_id > 9000"), "doc_id", "score"))
    assert score[9001] < toxicity.THRESHOLD <= score[9002]


def test_archives(spark, rows):
    some = [(d, f"http://x/{d}", t) for d, t in rows + [(9, rows[0][1])]]
    manifest = warc.write_archives(pages(spark, some), f"{runtime.shared_dir(spark)}/warc-{uuid.uuid4().hex}", least_bytes=0)
    out = warc.read_archives(manifest, range_bytes=50_000)
    assert got(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == in_order(wanted_records(some))


def test_substrings(spark, rows):
    out = substring_dedup.remove_repeats(frame(spark, rows)).withColumn("kept_sha256", F.sha2("kept", 256))
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(rows)


def test_jaccard(spark, rows):
    found = got(ngram_jaccard.jaccard_components(frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert found == brute_components(rows) and found[1][2] == 1
