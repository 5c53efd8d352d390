"""Toxicity by class-conditional Kneser-Ney models.

Two models of words as sequences of symbols, one of toxic and one of ordinary
labelled documents. Symbols are the bytes of the lower-cased word, all of them,
and its end; the history h of a symbol x is the whole word before it. With the
counts N_c of a class c, and the discount min(n, D) of a count n,

    p_c(x | h) = (max(N_c(hx) - D, 0) + (S + sum of discounts) p(x | h)) / (N_c(h) + S)

where p(x | h), the shared backoff, is the interpolated Kneser-Ney estimate
from the counts of both classes together. It falls back from the whole history
to the last two symbols and to none, where symbols are weighed by continuation
counts: by how many different histories they follow. Expressions that are rare
in both classes have the shared backoff in both models, so they don't decide:
below a history that no class has more than D times, both models are the same,
and nothing needs to be stored.

Most words of a toxic document are ordinary. So a word's likelihood in it is
(1 - MIX) p_0 + MIX p_1, and in any other document p_0. The statistic of a
document is the difference of both log-likelihoods over its number of words
plus `SMOOTH_WORDS`; every word counts, for either class. An isotonic curve,
which a few odd labels don't bend elsewhere, turns it into a score from 0 to 1.

Counts are taken over all labelled training rows and shuffled as partial sums;
all that follows is joins of tables keyed by history, so nothing of them
reaches the driver but the scoring table, which is broadcast up to `TABLE_ROWS`
rows; beyond that, distinct words are joined with it instead. The curve is
fitted on at most `CURVE_ROWS` labelled rows (those with the smallest hashes of
their ids), each scored by counts of the other training fold.

Null and empty texts, and texts without letters, have the statistic 0 and get
the curve's score of it. Very long texts are read in slices, very long words
symbol by symbol; neither is cut. Labels that are null, or of unknown
documents, are not used; of several labels of a document, each counts. Without
labels of both classes every score is the same. Repeated rows are scored each;
rows without a doc_id are scored, too. Other columns, among them lang and
source, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

DISCOUNT, STRENGTH, SHARED_DISCOUNT = 3, 2.0, 0.75
MIX, SMOOTH_WORDS = 0.002, 20.0
TABLE_ROWS, LABEL_ROWS, CURVE_ROWS = 2_000_000, 2_000_000, 20_000
THRESHOLD = 0.7
#: Bytes of text that are scored at a time: a worker's memory is some 25 times that beside its batch.
SCORED_BYTES = 1 << 19
COUNTS = ("a0", "a1", "b0", "b1")
#: Which counts are ordinary and toxic: of both training folds, of the first, of the second.
VARIANTS = ((("a0", "b0"), ("a1", "b1")), (("a0",), ("a1",)), (("b0",), ("b1",)))
#: Letters as they are modelled: A-Z lower-cased, bytes of other letters as they are, all else parts words.
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def ranges(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... sizes[0] - 1, 0, 1, ... sizes[1] - 1 and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class Words:
    """Words one after the other, each with the end mark (a space) behind it."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.full(int(self.sizes.sum()), 32, np.uint8)
        inner = ranges(sizes)
        self.data[np.repeat(self.starts, sizes) + inner] = data[np.repeat(starts, sizes) + inner]
        self.rolling = runtime.Rolling(runtime.byte_values(11)[self.data], 11)

    def node(self, which, length) -> np.ndarray:
        """Hashes of the first `length` symbols of these words; 0 of none."""
        return self.rolling.of(self.starts[which], length)


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """(a slice's distinct words, which of them each of its words is, each document's first word)."""
    data = _LETTER[data]
    starts, ends, first = runtime.word_spans(data, offsets)
    _, at, inverse = np.unique(runtime.word_hashes(data, starts, ends, 11), return_index=True, return_inverse=True)
    return Words(data, starts[at], (ends - starts)[at]), inverse, first


def count(rows: DataFrame) -> DataFrame:
    """Words of (text, toxic, fold) with their counts by fold and class."""

    def run(batches):
        for batch in batches:
            data, offsets = runtime.text_arrays(batch.column(0))
            group = batch.column(1).to_numpy() + 2 * batch.column(2).to_numpy()
            for a, b in runtime.slices(offsets):
                words, inverse, first = distinct_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                g, n = np.repeat(group[a:b], np.diff(first)), len(words.sizes)
                edges = np.append(words.starts, len(words.data))
                column = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(words.data)]).cast(pa.binary())
                yield pa.record_batch({"word": column, **{c: pa.array(np.bincount(inverse[g == i], minlength=n)) for i, c in enumerate(COUNTS)}})
            runtime.trim()

    found = rows.mapInArrow(run, "word binary, a0 long, a1 long, b0 long, b1 long")
    return found.groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS])


def histories(words: DataFrame) -> DataFrame:
    """(node, parent, gram) with counts: every beginning of a word, the one without its last symbol, its last three symbols."""

    def run(batches):
        for batch in batches:
            data, offsets = runtime.text_arrays(batch.column(0))
            counts = [batch.column(i + 1).to_numpy() for i in range(len(COUNTS))]
            for a, b in runtime.slices(offsets, 1 << 20):
                w = Words(data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a], np.diff(offsets[a : b + 1]) - 1)
                owner, depth = np.repeat(np.arange(b - a), w.sizes), ranges(w.sizes)
                symbol = w.data.astype(np.int32)
                gram = symbol.copy()
                for back in (1, 2):
                    gram[back:] |= np.where(depth[back:] >= back, symbol[: len(symbol) - back], 0) << (8 * back)
                every, at, inverse = np.unique(w.node(owner, depth + 1), return_index=True, return_inverse=True)
                parent = w.node(owner[at], depth[at])
                sums = [np.bincount(inverse, c[a:b][owner], len(every)).astype(np.int64) for c in counts]
                yield pa.record_batch({"node": pa.array(every.view(np.int64)), "parent": pa.array(parent.view(np.int64)), "gram": pa.array(gram[at]), **{c: pa.array(s) for c, s in zip(COUNTS, sums)}})

    found = words.mapInArrow(run, "node long, parent long, gram int, a0 long, a1 long, b0 long, b1 long")
    return found.groupBy("node", "parent", "gram").agg(*[F.sum(c).alias(c) for c in COUNTS])


def compile_tables(words: DataFrame) -> list[DataFrame]:
    """For each variant (node, step, back): the log ratio of a history's last symbol, and that of every symbol that isn't stored after it."""
    several = range(len(VARIANTS))
    nodes = histories(words)
    for v, classes in enumerate(VARIANTS):
        for name, columns in zip("ot", classes):
            nodes = nodes.withColumn(f"{name}{v}", sum(F.col(c) for c in columns))
    nodes = runtime.written(nodes.drop(*COUNTS), "histories")
    both = lambda v: F.col(f"o{v}") + F.col(f"t{v}")
    # continuation counts: of different histories before the last symbols
    grams = nodes.groupBy("gram").agg(*[F.sum((both(v) > 0).cast("long")).alias(f"c{v}") for v in several])
    grams = runtime.written(grams.withColumns({"last": F.expr("gram >> 8"), "symbol": F.expr("gram & 255")}), "grams")
    lasts = grams.groupBy("last").agg(*[e for v in several for e in (F.sum(f"c{v}").alias(f"cs{v}"), F.sum((F.col(f"c{v}") > 0).cast("long")).alias(f"ck{v}"))])
    symbols = grams.groupBy("symbol").agg(*[F.sum((F.col(f"c{v}") > 0).cast("long")).alias(f"u{v}") for v in several])
    whole = symbols.agg(*[e for v in several for e in (F.sum(f"u{v}").alias(f"us{v}"), F.sum((F.col(f"u{v}") > 0).cast("long")).alias(f"uk{v}"))])

    def discounted(n, total, kinds, lower):
        return (F.greatest(n - SHARED_DISCOUNT, F.lit(0.0)) + SHARED_DISCOUNT * kinds * lower) / F.greatest(total, F.lit(1))

    lower = grams.join(lasts, "last").join(symbols, "symbol").join(F.broadcast(whole))  # one row
    for v in several:
        alone = discounted(F.col(f"u{v}"), F.col(f"us{v}"), F.col(f"uk{v}"), F.lit(1 / 256))
        lower = lower.withColumn(f"low{v}", discounted(F.col(f"c{v}"), F.col(f"cs{v}"), F.col(f"ck{v}"), alone))
    lower = lower.select("gram", *[f"low{v}" for v in several])
    # what follows each history
    less = lambda c: F.sum(F.least(F.col(c), F.lit(DISCOUNT)))
    after = nodes.groupBy(F.col("parent").alias("h")).agg(
        *[e for v in several for e in (F.sum(f"o{v}").alias(f"ho{v}"), F.sum(f"t{v}").alias(f"ht{v}"), less(f"o{v}").alias(f"mo{v}"), less(f"t{v}").alias(f"mt{v}"), F.sum((both(v) > 0).cast("long")).alias(f"k{v}"))]
    )
    after = runtime.written(after, "after")
    weight = lambda x, v: (STRENGTH + F.col(f"m{x}{v}")) / (F.col(f"h{x}{v}") + STRENGTH)
    backs = after.select("h", *[(F.log(weight("t", v)) - F.log(weight("o", v))).alias(f"back{v}") for v in several])
    stored = lambda v: (F.col(f"o{v}") > DISCOUNT) | (F.col(f"t{v}") > DISCOUNT)
    steps = nodes.where(" OR ".join(f"o{v} > {DISCOUNT} OR t{v} > {DISCOUNT}" for v in several)).join(after, F.col("parent") == F.col("h")).join(lower, "gram")
    for v in several:
        shared = discounted(both(v), F.col(f"ho{v}") + F.col(f"ht{v}"), F.col(f"k{v}"), F.col(f"low{v}"))
        p = {x: F.greatest(F.col(f"{x}{v}") - DISCOUNT, F.lit(0)) / (F.col(f"h{x}{v}") + STRENGTH) + weight(x, v) * shared for x in "ot"}
        steps = steps.withColumn(f"step{v}", F.when(stored(v), F.log(p["t"]) - F.log(p["o"])))
    steps = steps.select("node", *[f"step{v}" for v in several]).join(backs.withColumnRenamed("h", "node"), "node", "left")
    # all words start from the empty history
    root = backs.where("h = 0").select(F.lit(0).cast("long").alias("node"), *[F.lit(0.0).alias(f"step{v}") for v in several], *[f"back{v}" for v in several])
    table = runtime.written(steps.unionByName(root), "tables")
    return [table.where(F.col(f"step{v}").isNotNull()).select("node", F.col(f"step{v}").alias("step"), F.coalesce(f"back{v}", F.lit(0.0)).alias("back")) for v in several]


class Table:
    """The scoring table as sorted arrays."""

    def __init__(self, node: np.ndarray, step: np.ndarray, back: np.ndarray):
        order = np.argsort(node)
        self.node, self.step, self.back = node[order], step[order], back[order]

    def of(self, words: Words) -> np.ndarray:
        """Each word's log ratio: the steps of its stored beginnings, then the last one's backoff."""
        out = np.zeros(len(words.sizes))
        if not len(self.node):
            return out
        root = np.searchsorted(self.node, np.uint64(0))
        going, last, depth = np.arange(len(out)), np.full(len(out), root), 1
        while len(going):
            node = words.node(going, depth)
            at = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
            hit = self.node[at] == node
            out[going] += np.where(hit, self.step[at], self.back[last])
            more = hit & (depth < words.sizes[going])
            going, last, depth = going[more], at[more], depth + 1
        return out


def evidence(ratio: np.ndarray) -> np.ndarray:
    """The log-likelihood of words in a toxic document less that in an ordinary one."""
    return np.logaddexp(math.log1p(-MIX), math.log(MIX) + ratio)


def statistics(documents: DataFrame, tables: list[DataFrame], curve: tuple[np.ndarray, np.ndarray] | None = None, held: list | None = None, text: bool = False) -> DataFrame:
    """The input's columns (but for `text`, if it isn't asked for), and one statistic a table (x0, x1, ...), or what the curve makes of it.

    Tables of up to TABLE_ROWS are arrays on the executors; held gets their broadcast, for callers that know when it's used up.
    """
    rest = [c for c in documents.columns if c != "text"]
    back = [*rest, *(["text"] if text else [])]
    rows = [t.count() for t in tables]
    if max(rows) > TABLE_ROWS:
        return statistics_by_join(documents, tables, curve, text)
    arrays = []
    for t in tables:
        got = t.toArrow()
        arrays.append((got.column("node").to_numpy().view(np.uint64), got.column("step").to_numpy(), got.column("back").to_numpy()))
        del got
    shared = documents.sparkSession.sparkContext.broadcast(arrays)
    del arrays
    runtime.trim()  # the driver has no more need of them
    if held is not None:
        held.append(shared)

    def run(batches):
        known = [Table(*x) for x in shared.value]
        for batch in batches:
            data, offsets = runtime.text_arrays(batch.column(batch.num_columns - 1))
            for a, b in runtime.slices(offsets, SCORED_BYTES):
                words, inverse, first = distinct_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                columns = [batch.column(i).slice(a, b - a) for i in range(len(back))]
                for t in known:
                    sums = np.concatenate(([0.0], np.cumsum(evidence(t.of(words))[inverse])))
                    x = (sums[first[1:]] - sums[first[:-1]]) / (np.diff(first) + SMOOTH_WORDS)
                    columns.append(pa.array(np.interp(x, *curve) if curve else x))
                yield pa.RecordBatch.from_arrays(columns, names=[*back, *[f"x{i}" for i in range(len(known))]])
            batch = data = offsets = words = inverse = first = columns = None  # gone before the next one is read
            runtime.trim()

    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in back), *(f"x{i} double" for i in range(len(tables)))])
    return documents.select(*rest, "text").mapInArrow(run, schema)


def statistics_by_join(documents: DataFrame, tables: list[DataFrame], curve: tuple[np.ndarray, np.ndarray] | None = None, text: bool = False) -> DataFrame:
    """The same for tables too large to broadcast: all distinct words are joined with the table, then the documents' words with them."""
    rest = [c for c in documents.columns if c != "text"]

    def run(batches):
        for batch in batches:
            data, offsets = runtime.text_arrays(batch.column(1))
            ids = batch.column(0).to_numpy()
            for a, b in runtime.slices(offsets, 1 << 20):
                words, inverse, first = distinct_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                key = words.node(np.arange(len(words.sizes)), words.sizes)
                doc = np.repeat(np.arange(a, b), np.diff(first))
                pairs, n = np.unique(doc * len(key) + inverse, return_counts=True)
                doc, which = pairs // max(len(key), 1), pairs % max(len(key), 1)
                edges = np.append(words.starts, len(words.data))
                column = pa.Array.from_buffers(pa.large_binary(), len(key), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(words.data)]).cast(pa.binary())
                yield pa.record_batch({"row": pa.array(ids[doc]), "key": pa.array(key.view(np.int64)[which]), "word": column.take(pa.array(which)), "n": pa.array(n)})

    def beginnings(batches):
        for batch in batches:
            data, offsets = runtime.text_arrays(batch.column(1))
            keys = batch.column(0).to_numpy()
            for a, b in runtime.slices(offsets, 1 << 20):
                w = Words(data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a], np.diff(offsets[a : b + 1]) - 1)
                owner, depth = np.repeat(np.arange(b - a), w.sizes), ranges(w.sizes)
                owner, depth = np.concatenate([np.arange(b - a), owner]), np.concatenate([np.zeros(b - a, np.int64), depth + 1])  # and the empty history
                yield pa.record_batch({"key": pa.array(keys[a:b][owner]), "size": pa.array(w.sizes[owner]), "depth": pa.array(depth), "node": pa.array(w.node(owner, depth).view(np.int64))})

    numbered = runtime.written(documents.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = runtime.written(numbered.select("_row", "text").mapInArrow(run, "row long, key long, word binary, n long"), "words")
    ways = runtime.written(found.groupBy("key").agg(F.first("word").alias("word")).mapInArrow(beginnings, "key long, size long, depth long, node long"), "beginnings")
    out = numbered.drop(*([] if text else ["text"])).join(found.groupBy("row").agg(F.sum("n").alias("words")), F.col("_row") == F.col("row"), "left").drop("row")
    for i, t in enumerate(tables):
        hits = ways.join(t, "node").groupBy("key", "size").agg(F.sum("step").alias("step"), F.max_by("back", "depth").alias("back"), F.max("depth").alias("depth"))
        ratio = F.col("step") + F.when(F.col("depth") < F.col("size"), F.col("back")).otherwise(0.0)
        sums = found.join(hits.select("key", F.log((1 - MIX) + MIX * F.exp(ratio)).alias("e")), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("e")).alias("s"))
        out = out.join(sums, F.col("_row") == F.col("row"), "left").withColumn(f"x{i}", F.coalesce("s", F.lit(0.0)) / (F.coalesce("words", F.lit(0)) + SMOOTH_WORDS)).drop("row", "s")
        if curve:
            out = out.withColumn(f"x{i}", F.pandas_udf(lambda x: pd.Series(np.interp(x, *curve)), "double")(f"x{i}"))
    return out.select(*rest, *(["text"] if text else []), *[f"x{i}" for i in range(len(tables))])


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the label on the statistic, by pooling neighbours that are out of order: (statistics, scores), linear in between.

    A hundredth of the score is the statistic's quantile, which keeps the order inside a pool. Without both classes the curve is flat.
    """
    if len(set(y.tolist())) < 2:
        return np.zeros(1), np.full(1, 0.1)
    at, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    pools: list[list[float]] = []  # sum of labels, rows, first and last statistic
    for lies, s, n in zip(at.tolist(), np.bincount(inverse, y).tolist(), count.tolist()):
        pools.append([s, n, lies, lies])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], last]
    sums, rows, first, last = np.array(pools).T
    value = np.interp(at, np.stack([first, last], 1).ravel(), np.repeat(sums / rows, 2))
    return at, 0.99 * value + 0.01 * (np.cumsum(count) - count / 2) / count.sum()


def remainder(column: str):
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def toxicity(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score) and the columns to keep (as a struct `kept`) a row; learns from labels whose id's remainder isn't 1."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)").where(remainder("id") != 1)
    known = runtime.written(known, "labels")
    n = known.count()
    known = known.withColumn("fold", (remainder("id") / 2).cast("int"))
    rows = docs.join(F.broadcast(known) if n <= LABEL_ROWS else known, docs.doc_id == known.id).where("text IS NOT NULL")
    tables = compile_tables(count(rows.select("text", "toxic", "fold")))
    chosen = known.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(CURVE_ROWS)  # at most so many rows, the documented bound
    sample = docs.join(F.broadcast(chosen), docs.doc_id == chosen.id).select("toxic", "fold", "text")
    held: list = []
    points = statistics(sample, tables[1:], held=held).toPandas()
    for shared in held:
        shared.destroy()
    x = np.where(points["fold"] == 0, points["x1"], points["x0"])  # by the other fold's counts
    curve = fit_curve(x.astype(float), points["toxic"].to_numpy().astype(float))
    # a text that is kept goes to the workers and back once
    place = {c: "text" if c == text_col and dict(documents.dtypes)[c] == "string" else f"_keep_{i}" for i, c in enumerate(keep)}
    passed = [F.col(c).alias(p) for c, p in place.items() if p != "text"]
    scored = statistics(documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *passed), tables[:1], curve, text="text" in place.values())
    return scored.select("doc_id", F.coalesce(remainder("doc_id") == 1, F.lit(False)).alias("held_out"), F.col("x0").alias("score"), *([F.struct(*[F.col(place[c]).alias(c) for c in keep]).alias("kept")] if keep else []))


def op7_toxicity(spark, sf_dir):
    out = toxicity(runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
