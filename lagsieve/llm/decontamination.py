"""Benchmark decontamination: size-partitioned MinHash containment search.

Finds the documents that hold at least `percent` per cent of a test item's
distinct 5-word shingles (A-Z lower-cased; with fewer words, the whole
sequence). Items are short and documents long, so similarity of whole sets says
nothing; containment of the item does.

1. Items are partitioned by the size of their set into classes of powers of
   two. An item's sketch holds the k smallest MinHash values (bottom-k) of its
   shingles. k follows from the class's largest size n: k = floor(n * (100 -
   percent) / 100) + 1, and so many values can't all be missed by a document
   that holds `percent` per cent. The search has no false negatives.
2. Every document's MinHash values probe the sketches. A pair is a candidate if
   it hits at least min(k, size) - floor(size * (100 - percent) / 100) values.
3. Candidates are verified: the item's shingles, as text, are counted in the
   document. Equal texts are verified once.

DataFrame and SQL functions only. Sketches and candidates are broadcast up to
`BROADCAST_ROWS` rows (counted first), and joined by shuffle beyond it. Texts
of any length are taken whole.

Null and empty texts, and null and empty items, have no shingles and match
nothing. Rows with the same doc_id are one document: its largest containment
counts. A null doc_id is passed on. Other columns are ignored; empty tables
give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .quality_rules import let

SHINGLE, PERCENT = 5, 75
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> str:
    """SQL: the lower-cased words of a text."""
    return rf"filter(split(translate({text}, '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def shingle_texts(text: str, n: int = SHINGLE) -> str:
    """SQL: the distinct shingles of a text, as text."""
    body = f"CASE WHEN size(ws) = 0 THEN array() WHEN size(ws) < {n} THEN array(array_join(ws, ' ')) ELSE array_distinct(transform(sequence(0, size(ws) - {n}), i -> array_join(slice(ws, i + 1, {n}), ' '))) END"
    return let(words(text), "ws", body)


def minhashes(text: str, n: int = SHINGLE) -> str:
    """SQL: the distinct MinHash values of a text's shingles: a hash of its words' hashes."""
    chain = ", ".join(f"get(h, i + {k})" for k in range(n))
    short = "array(aggregate(h, 42L, (a, x) -> xxhash64(a, x)))"
    body = f"CASE WHEN size(h) = 0 THEN array() WHEN size(h) < {n} THEN {short} ELSE array_distinct(transform(sequence(0, size(h) - {n}), i -> xxhash64({chain}))) END"
    return let(f"transform({words(text)}, w -> xxhash64(w))", "h", body)


def small(df: DataFrame) -> DataFrame:
    """The rows, to be broadcast if they are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def text_hashes(text: str) -> dict:
    """128 bits of hash of a text, as the columns t1 and t2."""
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(7), F.col(text))}


def sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(item_id, it, least, value): each item's k smallest values, k by its size class, and the hits that a candidate needs."""
    sized = items.select("item_id", "it", F.expr(minhashes("text")).alias("v")).withColumn("n", F.size("v")).where("n > 0")
    largest = "(CAST(power(2, floor(log2(n)) + 1) AS INT) - 1)"
    sized = sized.withColumn("k", F.expr(f"least(n, {largest} * {100 - percent} DIV 100 + 1)"))
    return sized.select("item_id", "it", F.expr(f"CAST(k - n * {100 - percent} DIV 100 AS INT)").alias("least"), F.explode(F.expr("slice(array_sort(v), 1, k)")).alias("value"))


def leaks(documents: DataFrame, items: DataFrame, *, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, t1, t2, item_id, n_item_shingles, n_shared) of every row and item with that much containment; t1 and t2 are text_hashes."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL")
    items = items.distinct().withColumn("it", F.xxhash64("text"))  # an id with several texts is several items, the best of which counts
    # texts are known by 128 bits of hash, so that copies cost one verification
    keyed = docs.where("text IS NOT NULL").withColumns(text_hashes("text"))
    sketch = runtime.written(sketches(items, percent), "sketches")
    # a copy's values are the same, so each text's hits are counted over distinct values
    probes = keyed.select("t1", "t2", F.explode(F.expr(minhashes("text"))).alias("value"))
    hits = probes.join(small(sketch), "value").groupBy("t1", "t2", "item_id", "it", "value").agg(F.max("least").alias("least"))
    candidates = hits.groupBy("t1", "t2", "item_id", "it").agg(F.count("*").alias("hits"), F.max("least").alias("least")).where("hits >= least")
    candidates = runtime.written(candidates.select("t1", "t2", "item_id", "it"), "candidates")
    texts = small(candidates.select("t1", "t2").distinct())
    suspects = keyed.join(texts, ["t1", "t2"], "left_semi").select("t1", "t2", "text").dropDuplicates(["t1", "t2"])
    found = suspects.select("t1", "t2", F.expr(shingle_texts("text")).alias("have"))
    wanted = items.select(F.col("item_id").alias("w_id"), F.col("it").alias("w_it"), F.expr(shingle_texts("text")).alias("want"))
    # a candidate is a row with both sets, so a shingle of many items costs nothing where they aren't candidates; null ids are ids like others
    asked = found.join(small(candidates), ["t1", "t2"])
    asked = asked.join(small(runtime.written(wanted, "items")), (F.col("it") == F.col("w_it")) & F.col("item_id").eqNullSafe(F.col("w_id")))
    counts = asked.select("t1", "t2", "item_id", "it", F.size("want").cast("long").alias("n_item_shingles"), F.size(F.array_intersect("have", "want")).cast("long").alias("n_shared"))
    verified = counts.where(f"100 * n_shared >= {percent} * n_item_shingles")
    verified = runtime.written(verified, "verified")
    pairs = keyed.select("doc_id", "t1", "t2").join(small(verified.withColumnsRenamed({"t1": "v1", "t2": "v2"})), (F.col("t1") == F.col("v1")) & (F.col("t2") == F.col("v2")))
    return pairs.select("doc_id", "t1", "t2", "item_id", "n_item_shingles", "n_shared")


def contained(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of every document and item with that much containment; options as for leaks."""
    best = F.struct((F.col("n_shared") / F.col("n_item_shingles")).alias("containment"), "n_item_shingles", "n_shared")
    out = leaks(documents, items, **options).groupBy("doc_id", "item_id").agg(F.max(best).alias("b"))
    return out.select("doc_id", "item_id", "b.n_item_shingles", "b.n_shared", "b.containment")


def op3_decontamination(spark, sf_dir):
    return contained(runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "benchmark"))


def oracle(n: int = SHINGLE, percent: int = PERCENT) -> str:
    """Exact containment of every item in every document, in DuckDB."""
    cut = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    grams = "SELECT DISTINCT id, array_to_string(words[i:i + {m}], ' ') AS s FROM (SELECT id, words, unnest(range(1, greatest(len(words) - {k}, 2))) AS i FROM (SELECT {id} AS id, {cut} AS words FROM {t}) WHERE len(words) > 0)"
    of = lambda t, key: grams.format(m=n - 1, k=n - 2, id=key, cut=cut, t=t)
    return rf"""
WITH d AS ({of('documents', 'doc_id')}), b AS ({of('benchmark', 'item_id')}),
c AS (SELECT id, count(*) AS n FROM b GROUP BY id),
p AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS k FROM d JOIN b USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item_shingles, CAST(k AS BIGINT) AS n_shared, CAST(k AS DOUBLE) / n AS containment
FROM p JOIN c ON c.id = item_id WHERE 100 * k >= {percent} * n
"""
