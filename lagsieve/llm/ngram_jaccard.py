"""N-gram Jaccard join by prefix trees over globally ordered shingle sets.

A document's set holds its distinct 5-word shingles (A-Z lower-cased); with
fewer words the whole sequence is the one shingle. Two documents link when
100 * |intersection| >= percent * |union|.

1. Equal sets are one class, stood for by its smallest doc_id.
2. Shingles are counted over the classes: distinct hashes meet in buckets, once
   a piece of documents. The global order is by frequency, then hash; shingles
   of one class only come first, and no list of them is ever made.
3. By the remaining-length bound, a set with over (100 - percent) % shingles of
   its own links with nothing. Of the others, two that link share one of the
   rarest |x| - ceil(percent * |x| / 100) + 1 shingles (the prefix). Sets that
   share a prefix shingle, directly or through others, make up a block.
4. A block is joined in one task by prefix trees (radix trees over the ordered
   sets): a probe walks down, sharing the overlap of common paths, and leaves a
   subtree when the overlap so far and what remains on either side can't reach
   the threshold. Each component found so far has a tree of its own, reached
   through the probe's prefix shingles, and is left at the first link. So a
   family of N near copies costs N walks, not its pairs, and only the links of
   a spanning forest leave the task.
   A block over `PART_SHINGLES` is dealt out in parts of that size. Each part
   collapses to its components; of each, one set goes on to the next round, so a
   large family is one component after a few rounds, wherever its sets lie.
   Then only sets are left to compare that share a prefix shingle with another
   component. They make up blocks of their own, in which parts of the largest
   component meet all other sets, and those each other (over `BLOCK_SHINGLES`,
   in parts that meet two by two). No pair of components is left out.
5. The links' connected components, by distributed rounds.

Null and empty texts have an empty set and link with nothing. Rows that share a
doc_id are one document: each of its texts links, and all have its component.
Very long texts are shingled a megabyte at a time. Rows without a doc_id get their set's size, link with
nothing and have no component. Other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .components import EDGES, Forest, components
from .decontamination import small

SHINGLE, PERCENT = 5, 75
BLOCK_SHINGLES, PART_SHINGLES = 4_000_000, 40_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of the distinct shingles, by document and hash; worked out over about a megabyte at a time."""
    parts = []
    for a, b in runtime.slices(offsets, 1 << 20):
        owner, hashes = shingles_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
        parts.append((owner + np.int32(a), hashes))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    return np.concatenate([o for o, _ in parts]), np.concatenate([h for _, h in parts])


def shingles_of(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = runtime.word_spans(data, offsets)
    rolling = runtime.Rolling(runtime.word_hashes(_LOWER[data], starts, ends))
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    k = max(len(doc) - n + 1, 0)
    at = np.flatnonzero(doc[:k] == doc[n - 1 :]) if k else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    hashes = np.concatenate([rolling.windows(n)[at], rolling.of(first[short], counts[short])])
    owner = np.concatenate([doc[at], short.astype(np.int32)])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return owner[keep], hashes[keep]


def signatures(documents: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, d1, d2) of each row: its set's size and a 128-bit digest of it. One narrow stage."""

    def run(batches):
        for batch in batches:
            data, offsets = runtime.text_arrays(batch.column(1))
            for a, b in runtime.slices(offsets):
                owner, h = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                d1, d2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                np.add.at(d1, owner, h)
                np.add.at(d2, owner, runtime.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.bincount(owner, minlength=b - a), pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))], names=["doc_id", "n_shingles", "d1", "d2"])
            batch = data = offsets = owner = h = None  # gone before the next one is read
            runtime.trim()

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long")


def chosen(table: pa.Table, right: pa.Table) -> pa.Table:
    """The rows of a piece whose document stands for a class, each of its texts once."""
    ids = right.column("rep").drop_null()
    table = runtime.ordered(table.filter(pa.compute.is_in(table.column("doc_id"), value_set=ids))).combine_chunks()
    if table.num_rows < 2:
        return table
    above, below = table.slice(0, table.num_rows - 1), table.slice(1)
    texts = [pa.compute.fill_null(x.column("text"), "") for x in (above, below)]  # null and empty texts have the same set
    again = pa.compute.and_(pa.compute.equal(above.column("doc_id"), below.column("doc_id")), pa.compute.equal(*texts)).to_numpy()
    return table.filter(pa.array(np.concatenate(([True], ~again))))


def order_keys(hashes: np.ndarray, n: int) -> np.ndarray:
    return runtime.bucket_of(hashes, n).astype(np.uint64) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


class Tree:
    """A radix tree over ordered sets. A node is [segment, children by first shingle, sizes that end here, smallest and largest size below, longest way down]."""

    def __init__(self):
        self.root = [np.zeros(0, np.uint64), {}, [], 1 << 60, 0, 0]
        self.sets: list[tuple[np.ndarray, int, int]] = []

    def add(self, tokens: np.ndarray, size: int, who: int) -> None:
        self.sets.append((tokens, size, who))
        node, at = self.root, 0
        while True:
            node[3], node[4], node[5] = min(node[3], size), max(node[4], size), max(node[5], len(tokens) - at)
            if at == len(tokens):
                node[2].append((size, who))
                return
            child = node[1].get(int(tokens[at]))
            if child is None:
                node[1][int(tokens[at])] = [tokens[at:], {}, [(size, who)], size, size, 0]
                return
            segment, rest = child[0], tokens[at : at + len(child[0])]
            differ = np.flatnonzero(segment[: len(rest)] != rest)
            same = int(differ[0]) if len(differ) else len(rest)
            if same < len(segment):  # split the child
                lower = [segment[same:], child[1], child[2], child[3], child[4], child[5]]
                child[0], child[1], child[2], child[5] = segment[:same], {int(segment[same]): lower}, [], child[5] + len(segment) - same
            node, at = child, at + same

    def link(self, tokens: np.ndarray, size: int, percent: int) -> int | None:
        """A set of the tree that links with this one, or None."""
        stack = [(self.root, 0, 0)]
        total = len(tokens)
        while stack:
            node, overlap, at = stack.pop()
            segment = node[0]
            if len(segment):
                where = np.searchsorted(tokens, segment)
                overlap += int(np.count_nonzero(tokens[np.minimum(where, total - 1)] == segment))
                at = int(np.searchsorted(tokens, segment[-1], side="right"))
            for other, who in node[2]:
                if (100 + percent) * overlap >= percent * (size + other):
                    return who
            # sizes below that can link at all, and the most overlap that is left on either side
            least, most = max(node[3], -(-percent * size // 100)), min(node[4], 100 * size // percent)
            if least <= most and (100 + percent) * (overlap + min(total - at, node[5])) >= percent * (size + least):
                stack += [(child, overlap, at) for child in node[1].values()]
        return None


def join_block(ids: list[int], sizes: list[int], sets: list[np.ndarray], prefixes: list[int], percent: int):
    """The links of a spanning forest of one block."""
    forest, trees, reached = Forest(), {}, {}
    for k in sorted(range(len(ids)), key=lambda i: (sizes[i], ids[i])):
        who, size, tokens = ids[k], sizes[k], sets[k]
        prefix = tokens[: prefixes[k]].tolist()
        roots = {forest.find(r) for t in prefix for r in reached.get(t, ())}
        joined = [Tree()]
        if (mine := forest.find(who)) in trees:  # a document of several rows
            joined.append(trees.pop(mine))
        for root in roots:
            if forest.find(root) == forest.find(who):
                continue
            other = trees[root].link(tokens, size, percent)
            if other is not None:
                yield who, other
                joined.append(trees.pop(root))
                forest.join(who, other)
        tree = max(joined, key=lambda x: len(x.sets))
        for other in joined:
            if other is not tree:
                for x in other.sets:
                    tree.add(*x)
        tree.add(tokens, size, who)
        trees[forest.find(who)] = tree
        for t in prefix:
            reached[t] = {forest.find(r) for r in reached.get(t, ())} | {forest.find(who)}


def jaccard_components(documents: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of the input."""
    spark = documents.sparkSession
    n = runtime.pieces(spark, documents, text_col)
    docs = runtime.in_pieces(documents, n, id_col, text_col)
    signed = runtime.written(signatures(docs, shingle), "signatures")
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    classes = runtime.written(classes, "classes")
    reps = classes.select(F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int").alias("piece"), "rep")

    def count(table: pa.Table, right: pa.Table) -> pa.Table:
        """A piece's distinct shingles, one row a bucket: lower bits, and whether two classes have it."""
        out = {"bucket": [], "piece": [], "low": [], "several": []}
        if table.num_rows and right.num_rows:
            piece = table.column("piece")[0].as_py()
            table = chosen(table, right)
            _, h = shingles(*runtime.text_arrays(table.column("text")), shingle)
            key, times = np.unique(order_keys(h, n), return_counts=True)
            low = key.astype(np.uint32)
            for b, i, j in runtime.by_bucket((key >> np.uint64(32)).astype(np.int64))[1]:
                out["bucket"].append(b)
                out["piece"].append(piece)
                out["low"].append(low[i:j].tobytes())
                out["several"].append(np.packbits(times[i:j] > 1).tobytes())
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "piece": pa.array(out["piece"], pa.int32()), "low": pa.array(out["low"], pa.binary()), "several": pa.array(out["several"], pa.binary())})

    def frequent(table: pa.Table) -> pa.Table:
        """To each piece its shingles of a bucket that several classes have, with their place in the global order."""
        bucket = table.column("bucket")[0].as_py()
        low = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("low")]
        several = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(k)) for x, k in zip(table.column("several"), low)])
        every, inverse, times = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
        times = times + np.bincount(inverse, several, len(every)).astype(np.int64)
        good, times = every[times > 1], times[times > 1]
        weight = np.minimum(12 * np.log2(times), 255).astype(np.uint8)  # a twelfth of a power of two, up to 2 million pieces
        hits, weights = [], []
        for x in low:
            x = x[runtime.member_of(x, good)]
            hits.append((x.astype(np.uint64) | np.uint64(bucket << 32)).tobytes())
            weights.append(weight[np.searchsorted(good, x)].tobytes())
        return pa.table({"piece": pa.array(table.column("piece").to_pylist(), pa.int32()), "rep": pa.nulls(len(low), pa.int64()), "hits": pa.array(hits, pa.binary()), "weights": pa.array(weights, pa.binary())}).filter(pa.array([len(x) > 0 for x in hits]))

    def survivors(table: pa.Table, right: pa.Table) -> pa.Table:
        """The sets of a piece that can link: shared shingles in global order, and how many of them are prefix."""
        out = {"doc_id": [], "size": [], "tokens": [], "prefix": []}
        hits = [np.frombuffer(x.as_buffer(), np.uint64) for x in right.column("hits").drop_null()]
        if table.num_rows and hits:
            key = np.concatenate(hits)
            weight = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in right.column("weights").drop_null()])
            order = np.argsort(key)
            key, weight = key[order], weight[order]
            table = chosen(table, right)
            ids = table.column("doc_id").to_pylist()
            owner, h = shingles(*runtime.text_arrays(table.column("text")), shingle)
            sizes = np.bincount(owner, minlength=len(ids))
            own = order_keys(h, n)
            shared = runtime.member_of(own, key)
            token = weight[np.searchsorted(key, own[shared])].astype(np.uint64) << np.uint64(56) | h[shared] >> np.uint64(8)
            owner = owner[shared]
            order = np.lexsort((token, owner))
            token, first = token[order], np.searchsorted(owner, np.arange(len(ids) + 1))
            for d in range(len(ids)):
                size, m = int(sizes[d]), int(first[d + 1] - first[d])
                need = -(-percent * size // 100)
                if m >= need and m:
                    out["doc_id"].append(ids[d])
                    out["size"].append(size)
                    out["tokens"].append(token[first[d] : first[d + 1]].tobytes())
                    out["prefix"].append(m - need + 1)
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "size": pa.array(out["size"], pa.int64()), "tokens": pa.array(out["tokens"], pa.binary()), "prefix": pa.array(out["prefix"], pa.int64())})

    counted = docs.groupBy("piece").cogroup(reps.groupBy("piece")).applyInArrow(runtime.lean_pair(count), "bucket int, piece int, low binary, several binary")
    replies = counted.groupBy("bucket").applyInArrow(runtime.lean(frequent), "piece int, rep long, hits binary, weights binary")
    told = replies.unionByName(reps.select("piece", "rep"), allowMissingColumns=True)
    alive = runtime.written(docs.groupBy("piece").cogroup(told.groupBy("piece")).applyInArrow(runtime.lean_pair(survivors), "doc_id long, size long, tokens binary, prefix long"), "sets")
    links = runtime.written(tree_join(alive, percent).unionByName(own_links(signed, classes)), "links")
    nodes = components(links, "links")
    labelled = classes.join(nodes, classes.rep == nodes.id, "left").select((F.col("d1") + F.lit(0)).alias("k1"), (F.col("d2") + F.lit(0)).alias("k2"), F.coalesce("component", "rep").alias("component"))
    found = signed.join(labelled, (signed.d1 == labelled.k1) & (signed.d2 == labelled.k2) & (signed.n_shingles > 0) & signed.doc_id.isNotNull(), "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def own_links(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links of the documents whose rows have several sets with the documents that stand for them."""
    sets = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "d1", "d2")
    several = sets.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("low"), F.max(F.struct("d1", "d2")).alias("high")).where("low <> high").select(F.col("doc_id").alias("id"))
    theirs = sets.join(several, sets.doc_id == F.col("id"), "left_semi").distinct()
    return theirs.join(classes, ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def prefixes(sets: DataFrame) -> DataFrame:
    """(token, doc_id) of every set's prefix."""

    def explode(batches):
        for batch in batches:
            heads = [np.frombuffer(x.as_buffer(), np.uint64)[:p] for x, p in zip(batch.column(1), batch.column(2).to_pylist())]
            if heads:
                yield pa.record_batch({"token": pa.array(np.concatenate(heads).view(np.int64)), "doc_id": pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in heads]))})

    return sets.select("doc_id", "tokens", "prefix").mapInArrow(explode, "token long, doc_id long")


def in_blocks(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """The sets that share a token of rows (token, doc_id) with others, directly or through more, with their block."""
    pivots = rows.groupBy("token").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot < last")
    pivots = small(runtime.written(pivots.select((F.col("token") + F.lit(0)).alias("key"), "pivot"), "pivots"))
    stars = rows.join(pivots, rows.token == pivots.key).where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))
    blocks = runtime.written(components(stars.distinct(), "blocks"), "blocks")
    return sets.join(blocks.select(F.col("id").alias("doc_id"), F.col("component").alias("block")), "doc_id")


def masses(sets: DataFrame) -> DataFrame:
    return sets.groupBy(F.col("block").alias("key")).agg(F.sum(F.octet_length("tokens") / 8).alias("mass"))


def forests(sets: DataFrame, percent: int) -> DataFrame:
    """Links of a spanning forest of each block's sets that share k0, k1 and k2."""

    def join(table: pa.Table) -> pa.Table:
        a, b = [], []
        block = table.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        cut = np.flatnonzero(np.diff(block[order], prepend=block[order[0]] - 1))
        ids, sizes, prefixes_ = (table.column(c).to_pylist() for c in ("doc_id", "size", "prefix"))
        tokens = table.column("tokens")
        for i, j in zip(cut, [*cut[1:], len(order)]):
            rows_ = order[i:j].tolist()
            sets_ = [np.frombuffer(tokens[r].as_buffer(), np.uint64) for r in rows_]
            for x, y in join_block([ids[r] for r in rows_], [sizes[r] for r in rows_], sets_, [prefixes_[r] for r in rows_], percent):
                a.append(x)
                b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sets.select("block", "doc_id", "size", "tokens", "prefix", "k0", "k1", "k2").groupBy("k0", "k1", "k2").applyInArrow(runtime.lean(join), EDGES)


def tree_join(alive: DataFrame, percent: int) -> DataFrame:
    """Links of a spanning forest of the sets (doc_id, size, tokens, prefix), found block by block."""
    sets = in_blocks(alive, prefixes(alive))
    mass = runtime.written(masses(sets), "masses")
    total = mass.agg(F.sum("mass")).first()[0] or 0
    bins = max(int(alive.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // BLOCK_SHINGLES) + 1)
    sets = sets.join(small(mass), sets.block == mass.key)
    # small blocks share bins
    little = sets.where(F.col("mass") <= PART_SHINGLES).withColumns({"k0": F.pmod(F.xxhash64("block"), F.lit(bins)), "k1": F.lit(-1), "k2": F.lit(-1)})
    links = forests(little, percent)
    if mass.where(F.col("mass") > PART_SHINGLES).isEmpty():
        return links
    large = runtime.written(sets.where(F.col("mass") > PART_SHINGLES).drop("key", "mass"), "large")
    return links.unionByName(join_large(large, percent))


def join_large(sets: DataFrame, percent: int) -> DataFrame:
    """Links of large blocks: parts collapse to components, whose representatives are joined in turn; what is left are sets that share a prefix shingle with another component."""
    links, current, before = None, sets, sets.count()
    for salt in range(64):  # each round leaves half of the sets at most
        size = masses(current)
        parts = size.select("key", F.ceil(F.col("mass") / PART_SHINGLES).cast("int").alias("parts"))
        parts = runtime.written(parts, "parts")
        dealt = current.join(small(parts), current.block == parts.key).withColumns({"k0": F.col("block"), "k1": F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col("parts")).cast("int"), "k2": F.lit(-2)})
        found = runtime.written(forests(dealt, percent), "found")
        links = found if links is None else links.unionByName(found)
        nodes = runtime.written(components(links, "collapsed"), "nodes")
        labelled = sets.join(nodes, sets.doc_id == nodes.id, "left").withColumn("component", F.coalesce("component", "doc_id")).drop("id")
        current = runtime.written(labelled.where("doc_id = component").drop("component"), "representatives")
        left = current.count()
        if 2 * left > before or parts.agg(F.max("parts")).first()[0] == 1:
            break
        before = left
    # pairs that may still link are of different components and share a prefix shingle
    owner = labelled.select(F.col("doc_id").alias("o"), F.col("component").alias("c")).distinct()
    rows = prefixes(sets).join(owner, F.col("doc_id") == F.col("o"))
    mixed = rows.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select(F.col("token").alias("m"))
    mixed = small(runtime.written(mixed, "tokens"))
    rows = runtime.written(rows.join(mixed, F.col("token") == F.col("m"), "left_semi").select("token", "doc_id"), "mixed")
    if rows.isEmpty():
        return links
    return links.unionByName(between_components(in_blocks(sets.drop("block"), rows), owner, percent))


def between_components(sets: DataFrame, owner: DataFrame, percent: int) -> DataFrame:
    """Links between sets of one block and different components (o, c): parts of each block's largest component meet all its other sets, and these meet each other."""
    sets = runtime.written(sets.join(owner, F.col("doc_id") == F.col("o")).drop("o"), "rest")
    mass = sets.groupBy("block", "c").agg(F.sum(F.octet_length("tokens") / 8).alias("m"))
    size = mass.groupBy(F.col("block").alias("key")).agg(F.max_by("c", "m").alias("top"), F.max("m").alias("most"), F.sum("m").alias("all"))
    many = lambda m, unit: F.greatest(F.ceil(m / unit), F.lit(1)).cast("int")
    size = size.select("key", "top", many(F.col("most"), PART_SHINGLES).alias("parts"), many(F.col("all") - F.col("most"), BLOCK_SHINGLES).alias("others"))
    size = small(runtime.written(size, "sizes"))
    sets = sets.join(size, sets.block == size.key)
    one = F.xxhash64("doc_id")
    part, other = F.pmod(one, F.col("parts")).cast("int"), F.pmod(one, F.col("others")).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    largest = sets.where("c = top").withColumns({"k0": F.col("block"), "k1": -1 - part}).withColumn("k2", upto("others"))
    rest = sets.where("c <> top").withColumns({"k0": F.col("block"), "k2": other})
    met = rest.withColumn("at", upto("parts")).withColumn("k1", -1 - F.col("at")).drop("at")
    twice = rest.withColumn("with", upto("others")).withColumns({"k1": F.least("k2", "with"), "k2": F.greatest("k2", "with")}).drop("with")
    columns = ("block", "doc_id", "size", "tokens", "prefix", "k0", "k1", "k2")
    return forests(largest.select(*columns).unionByName(met.select(*columns)).unionByName(twice.select(*columns)), percent)


def op10_ngram_jaccard(spark, sf_dir):
    return jaccard_components(runtime.table(spark, sf_dir, "documents"))


def oracle(n: int = SHINGLE, percent: int = PERCENT) -> str:
    """The definition in DuckDB: shared shingles counted by a join, components by recursion."""
    return rf"""
WITH RECURSIVE a AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + {n - 1}], ' ')) AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {n - 2}, 2))) AS i FROM a WHERE len(words) > 0)),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS i, y.doc_id AS j, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT i, j FROM p JOIN c ci ON ci.doc_id = i JOIN c cj ON cj.doc_id = j WHERE 100 * k >= {percent} * (ci.n + cj.n - k)),
b AS MATERIALIZED (SELECT i, j FROM e UNION ALL SELECT j, i FROM e),
r(id, to_id) AS (SELECT doc_id, doc_id FROM a UNION SELECT r.id, b.j FROM r JOIN b ON r.to_id = b.i)
SELECT a.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM a LEFT JOIN c USING (doc_id) JOIN (SELECT id, min(to_id) AS component_id FROM r GROUP BY id) m ON m.id = a.doc_id
"""
