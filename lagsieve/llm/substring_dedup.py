"""Substring deduplication with fixed-block anchors.

A window is `window` (13) consecutive words of one document. Every word is
removed that a window covers whose words also start in a document with a
smaller doc_id. Windows are judged on the input, not on what is left.

1. Index and probe. Each document is cut into non-overlapping blocks of
   b = (window + 1) / 2 words, the reference blocks; any window holds a whole
   one. Every rolling b-word window probes the index of blocks. Hashes meet in
   buckets, once a piece of documents, so a passage in a third of all documents
   is one entry a piece there.
2. Extend. Positions whose probe hit a block that two documents share are the
   anchors. An anchor is extended word by word as far as the text repeats: each
   window that holds an anchor is looked up by its hash, and the smallest
   document that has it decides. Adjoining hits make up the maximal exact
   repeats. No pairs of documents are made, so N copies cost N lookups.
3. Remove. The covered words go; the rest is joined by single spaces.

Texts are dealt out once, by document, and every step reads that exchange.
Windows are compared by 64 bits of hash and a bucket of a second hash; anchors
by 32 bits and their bucket, which can only add lookups.

Null and empty texts have no words and nothing removed. Rows with the same
doc_id do not remove each other's words. Rows without a doc_id come after all
others. Other columns are ignored; an empty table gives no rows; very long
texts are judged whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import runtime

WINDOW = 13
HIT = "piece int, hits binary"
OUT = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string"


class Words:
    """The words of a piece's documents, as hashes."""

    def __init__(self, table: pa.Table):
        self.table = runtime.ordered(table)
        self.ids = runtime.id_array(self.table.column("doc_id").combine_chunks())
        self.data, self.offsets = runtime.text_arrays(self.table.column("text"))
        self.starts, self.ends, self.first = runtime.word_spans(self.data, self.offsets)
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return runtime.word_hashes(self.data, self.starts, self.ends)

    def whole(self, n: int) -> np.ndarray:
        """Starts of the n-word windows that lie within one document."""
        k = len(self.doc) - n + 1
        return np.flatnonzero(self.doc[: max(k, 0)] == self.doc[n - 1 :]) if k > 0 else np.zeros(0, np.int64)


def keys(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket and lower 32 bits of a hash as one number."""
    return runtime.bucket_of(hashes, n_buckets).astype(np.uint64) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def anchors(words: Words, rolling: runtime.Rolling, block: int, window: int):
    """Starts of the rolling block-word windows, their hashes, and which of them are reference blocks; documents too short for a window have none."""
    at = words.whole(block)
    at = at[np.diff(words.first)[words.doc[at]] >= window]
    return at, rolling.windows(block)[at], (at - words.first[words.doc[at]]) % block == 0


def remove_repeats(documents: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: n_words, n_removed, the removed stretches (word numbers, ends exclusive), and the kept words."""
    block = (window + 1) // 2
    spark = documents.sparkSession
    n = runtime.pieces(spark, documents, text_col)
    docs = runtime.in_pieces(documents, n, id_col, text_col)

    def probe(table: pa.Table) -> pa.Table:
        """A piece's distinct block and probe hashes, one row a bucket: lower bits, whether a reference block has it, whether two documents have it."""
        piece, words = table.column("piece")[0].as_py(), Words(table)
        at, h, reference = anchors(words, runtime.Rolling(words.hashes()), block, window)
        key = keys(h, n)
        order = np.argsort(key, kind="stable")
        key, doc, reference = key[order], words.doc[at][order], reference[order]
        head = np.flatnonzero(np.diff(key, prepend=~key[:1])) if len(key) else np.zeros(0, np.int64)
        any_reference = np.logical_or.reduceat(reference, head) if len(head) else np.zeros(0, bool)
        last = np.append(head[1:], len(key)) - 1
        several = words.ids[doc[head]] != words.ids[doc[last]] if len(head) else np.zeros(0, bool)  # a stable sort keeps documents in order
        key = key[head]
        _, parts = runtime.by_bucket((key >> np.uint64(32)).astype(np.int64))
        low = key.astype(np.uint32)
        return pa.table({
            "bucket": pa.array([b for b, _, _ in parts], pa.int32()),
            "piece": pa.array([piece] * len(parts), pa.int32()),
            "low": pa.array([low[i:j].tobytes() for _, i, j in parts], pa.binary()),
            "reference": pa.array([np.packbits(any_reference[i:j]).tobytes() for _, i, j in parts], pa.binary()),
            "several": pa.array([np.packbits(several[i:j]).tobytes() for _, i, j in parts], pa.binary()),
        })

    def shared(table: pa.Table) -> pa.Table:
        """To each piece its hashes of a bucket that a reference block and two documents have."""
        bucket = table.column("bucket")[0].as_py()
        low = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("low")]
        sizes = [len(x) for x in low]
        bits = lambda name: np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=k) for x, k in zip(table.column(name), sizes)])
        every, inverse, count = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
        reference = np.bincount(inverse, bits("reference"), len(every)) > 0
        several = (np.bincount(inverse, bits("several"), len(every)) > 0) | (count > 1)
        good = every[reference & several]
        hits = [x[runtime.member_of(x, good)].astype(np.uint64) | np.uint64(bucket << 32) for x in low]
        return pa.table({"piece": pa.array(table.column("piece").to_pylist(), pa.int32()), "hits": pa.array([x.tobytes() for x in hits], pa.binary())}).filter(pa.array([len(x) > 0 for x in hits]))

    def extend(table: pa.Table, hit: pa.Table) -> pa.Table:
        """A piece's distinct windows that hold an anchor, with the smallest document that has each, one row a bucket."""
        out = {"bucket": [], "piece": [], "window": [], "least": [], "base": []}
        if table.num_rows and hit.num_rows:
            piece, words = table.column("piece")[0].as_py(), Words(table)
            values = words.hashes()
            rolling = runtime.Rolling(values)
            at, h, _ = anchors(words, rolling, block, window)
            held = np.zeros(len(words.doc) + 1, np.int64)
            held[1:][at[runtime.member_of(keys(h, n), found(hit))]] = 1
            held = np.cumsum(held)
            at = words.whole(window)
            at = at[held[at + window - block + 1] > held[at]]
            h, second = rolling.windows(window)[at], runtime.Rolling(values, 2).windows(window)[at]
            bucket = runtime.bucket_of(second, n)
            order = np.lexsort((at, h, bucket))
            h, bucket, doc = h[order], bucket[order], words.ids[words.doc[at[order]]]
            head = np.flatnonzero((np.diff(h, prepend=~h[:1]) != 0) | (np.diff(bucket, prepend=-1) != 0)) if len(h) else np.zeros(0, np.int64)
            h, bucket, doc = h[head], bucket[head], doc[head]
            for b, i, j in runtime.by_bucket(bucket)[1]:
                low = int(doc[i:j].min())
                rest = doc[i:j].astype(np.uint64) - np.uint64(low & ((1 << 64) - 1))
                out["bucket"].append(b)
                out["piece"].append(piece)
                out["window"].append(h[i:j].tobytes())
                out["least"].append(rest.astype(np.uint32).tobytes() if int(rest.max()) < 1 << 32 else rest.tobytes())
                out["base"].append(low)
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "piece": pa.array(out["piece"], pa.int32()), "window": pa.array(out["window"], pa.binary()), "least": pa.array(out["least"], pa.binary()), "base": pa.array(out["base"], pa.int64())})

    def earlier(table: pa.Table) -> pa.Table:
        """To each piece the windows that a smaller document of another piece has."""
        window_ = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("window")]
        least = []
        for x, raw, base in zip(window_, table.column("least"), table.column("base").to_pylist()):
            raw = raw.as_buffer()
            rest = np.frombuffer(raw, np.uint32 if raw.size == 4 * len(x) else np.uint64).astype(np.uint64)
            least.append((rest + np.uint64(base & ((1 << 64) - 1))).astype(np.int64))
        every, inverse = np.unique(np.concatenate(window_), return_inverse=True)
        first = np.full(len(every), np.iinfo(np.int64).max)
        np.minimum.at(first, inverse, np.concatenate(least))
        hits = []
        for x, own in zip(window_, least):
            hits.append(x[first[np.searchsorted(every, x)] < own])
        return pa.table({"piece": pa.array(table.column("piece").to_pylist(), pa.int32()), "hits": pa.array([x.tobytes() for x in hits], pa.binary())}).filter(pa.array([len(x) > 0 for x in hits]))

    def remove(table: pa.Table, hit: pa.Table) -> pa.Table:
        """The documents of a piece without their covered words."""
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in zip(("doc_id", "n_words", "n_removed", "removed", "kept"), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()))})
        words = Words(table)
        at = words.whole(window)
        h = runtime.Rolling(words.hashes()).windows(window)[at]
        doc = words.ids[words.doc[at]]
        order = np.argsort(h, kind="stable")  # documents stand by id, so the first of equal windows has the smallest
        head = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]])) if len(h) else np.zeros(0, np.int64)
        least = np.zeros(len(h), np.int64)
        least[order] = np.repeat(doc[order[head]], np.diff(np.append(head, len(h))))
        gone = at[(least < doc) | runtime.member_of(h, found(hit))]
        depth = np.zeros(len(words.doc) + 1, np.int64)
        np.add.at(depth, gone, 1)
        np.add.at(depth, gone + window, -1)
        covered = np.cumsum(depth[:-1]) > 0
        sums = np.concatenate(([0], np.cumsum(covered)))
        n_removed = sums[words.first[1:]] - sums[words.first[:-1]]
        kept, removed, raw = [], [], words.data.tobytes()
        for d in range(len(words.ids)):
            a, b = int(words.first[d]), int(words.first[d + 1])
            text = raw[words.offsets[d] : words.offsets[d + 1]]
            if not n_removed[d]:
                kept.append(b" ".join(text.split()))
                removed.append([])
                continue
            mask = covered[a:b]
            edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
            removed.append([{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())])
            kept.append(b" ".join([w for w, gone_ in zip(text.split(), mask.tolist()) if not gone_]))
        return pa.table({
            "doc_id": words.table.column("doc_id"), "n_words": pa.array(np.diff(words.first), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    probes = docs.groupBy("piece").applyInArrow(runtime.lean(probe), "bucket int, piece int, low binary, reference binary, several binary")
    hits = probes.groupBy("bucket").applyInArrow(runtime.lean(shared), HIT)
    lookups = docs.groupBy("piece").cogroup(hits.groupBy("piece")).applyInArrow(runtime.lean_pair(extend), "bucket int, piece int, window binary, least binary, base long")
    repeats = lookups.groupBy("bucket").applyInArrow(runtime.lean(earlier), HIT)
    return docs.groupBy("piece").cogroup(repeats.groupBy("piece")).applyInArrow(runtime.lean_pair(remove), OUT)


def found(hit: pa.Table) -> np.ndarray:
    """The hashes sent back to a piece, sorted."""
    if not hit.num_rows:
        return np.zeros(0, np.uint64)
    return np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in hit.column("hits")]))


def op9_substring_dedup(spark, sf_dir):
    return remove_repeats(runtime.table(spark, sf_dir, "documents")).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) AS kept_sha256")


def oracle(window: int = WINDOW) -> str:
    """The definition in DuckDB: every window, its smallest document, the words it covers."""
    w = window
    return rf"""
WITH a AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, i, hash(array_to_string(words[i:i + {w - 1}], ' ')) AS h, md5(array_to_string(words[i:i + {w - 1}], ' ')) AS m
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - {w - 2})) AS i FROM a WHERE len(words) >= {w})),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h, m) AS low FROM g) WHERE low < doc_id),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(range(0, {w})) AS k)),
u AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM a),
k AS (SELECT u.doc_id, count(c.i) AS n_removed, string_agg(CASE WHEN c.i IS NULL THEN word END, ' ' ORDER BY u.i) AS kept
      FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.i = c.i GROUP BY u.doc_id)
SELECT a.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM a LEFT JOIN k USING (doc_id)
"""
