"""Exact repeats of `length` (400) bytes, found by prefix-free parsing.

A byte is removed if a string of `length` bytes that covers it also starts
anywhere else, in the same document or another; overlaps count, documents do
not join, and strings are judged on the input.

Parsing. A rolling hash of `TRIGGER` bytes that meets the condition (one in
`SPACING`) is a trigger; triggers cut each text into phrases. They depend on
nothing but the bytes around them, so equal strings are cut alike. The suffix
that starts at byte i is a suffix of its phrase (a dictionary suffix) followed
by the parse from the next trigger t on.

1. Parse suffixes of `length - REACH` bytes, `REACH` being the most bytes
   between i and its trigger, that occur once in the corpus (the bulk of
   ordinary text) are done with.
2. The others are compared with their phrase and all `length` bytes in front of
   them. Equal ones are repeats as a whole: every start in the phrase is,
   without a look at single bytes. This is where repetitive text collapses.
3. Where a parse suffix goes with different phrases or continuations (the ends
   of repeats), and where no trigger lies within `REACH` bytes, every start
   counts. Each piece of documents puts them in corpus order by the suffix
   arrays of its dictionary and of its parse (`suffix_order`): neighbours whose
   common prefix has `length` bytes are equal, byte for byte. One of each run
   of equal strings goes on to the other pieces.

Pieces meet in buckets of fingerprints, to which each sends its distinct ones:
a string in a third of all documents is one entry a piece. Nothing is sent for
pairs. What decides that strings of different pieces are equal has 96 bits;
step 1, which only chooses what the others look at, has 32 and the bucket.

Null and empty texts have no bytes. Repeated rows are documents of their own,
so their long strings are repeats. doc_id may be null. Texts over `GROUP_BYTES`
are parsed in overlapping parts. Other columns, whatever their names, are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, suffix_order

LENGTH, TRIGGER, SPACING, REACH = 400, 8, 16, 128
GROUP_BYTES = 1 << 20
#: Bytes of which one corpus order is made; the strings of several meet as those of several pieces do.
ORDER_BYTES = 2 << 20
HIT = "piece int, bucket int, hits binary, checks binary, states binary"
OUT = "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary"
WHOLE, OPEN, BOTH = 1, 2, 3


def spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [low, high]."""
    counts = np.maximum(high - low + 1, 0)
    if not len(counts) or not counts.sum():
        return np.zeros(0, np.int64)
    return np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())


class Parsed:
    """Some whole documents, or a part of a long one, cut into phrases. Positions are bytes of the piece."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, base: int, own: tuple[int, int], length: int):
        self.base, self.length, self.data, self.bounds = base, length, data, bounds
        self.rolling = runtime.Rolling(runtime.byte_values(7)[data], 7)
        n = len(data)
        windows = self.rolling.prefix[TRIGGER:] - self.rolling.prefix[: n + 1 - TRIGGER] if n >= TRIGGER else np.zeros(0, np.uint64)
        windows = windows * self.rolling.inverse[: len(windows)] * np.uint64(0x9E3779B97F4A7C15)
        t = np.flatnonzero(windows >> np.uint64(40) & np.uint64(0xFFFFFF) < np.uint64((1 << 24) // SPACING))
        v = np.searchsorted(bounds, t, side="right") - 1
        inside = t + TRIGGER <= bounds[v + 1]
        self.cuts = t, v = t[inside], v[inside]
        start, end = bounds[v], bounds[v + 1]
        before = np.concatenate(([-1], t[:-1]))
        low = np.maximum(np.maximum(before + 1, t - REACH + 1), start)
        use = (low + length <= end) & (t >= own[0]) & (t < own[1])
        self.t, self.low, self.high, self.end = t[use], low[use], np.minimum(t, end - length)[use], end[use]
        # starts without a trigger within reach: in long phrases, and after a document's last trigger
        has = np.searchsorted(v, np.arange(len(bounds)))
        last = np.where(has[1:] > has[:-1], t[has[1:] - 1] if len(t) else 0, bounds[:-1] - 1)
        a = np.concatenate([np.maximum(before + 1, start), last + 1])
        b = np.concatenate([np.minimum(t - REACH, end - length), bounds[1:] - length])
        a, b = np.maximum(a, own[0]), np.minimum(b, own[1] - 1)
        self.far_low, self.far_high = a[a <= b], b[a <= b]

    def parse_suffixes(self) -> np.ndarray:
        return self.rolling.of(self.t, self.length - REACH)

    def hashes(self, starts: np.ndarray, lengths) -> "runtime.Pairs":
        """96 bits of each stretch."""
        if not hasattr(self, "second"):
            self.second = runtime.Rolling(runtime.byte_values(8)[self.data], 8)
        return runtime.Pairs(self.rolling.of(starts, lengths), (self.second.of(starts, lengths) >> np.uint64(32)).astype(np.uint32))

    def contexts(self, which=slice(None)) -> "runtime.Pairs":
        """Phrase and following bytes: all that the strings that start in the phrase can see."""
        return self.hashes(self.low[which], np.minimum(self.t[which] + self.length, self.end[which]) - self.low[which])

    def strings(self, at: np.ndarray) -> "runtime.Pairs":
        return self.hashes(at, self.length)

    def regions(self, at: np.ndarray):
        """(text, (starts, ends), triggers, at) of the stretches that strings at these sorted starts cover, laid end to end."""
        doc = np.searchsorted(self.bounds, at, side="right") - 1
        new = np.concatenate(([True], (at[1:] > at[:-1] + self.length) | (doc[1:] != doc[:-1])))
        head = np.flatnonzero(new)
        first, last = at[head], at[np.append(head[1:], len(at)) - 1] + self.length
        offset = np.cumsum(last - first) - (last - first)
        t = self.cuts[0]
        where = np.searchsorted(first, t, side="right") - 1
        t, where = t[where >= 0], where[where >= 0]
        inside = t + TRIGGER <= last[where]
        t, where = t[inside], where[inside]
        return self.data[spread(first, last - 1)], (offset, offset + last - first), t - first[where] + offset[where], at - np.repeat(first - offset, np.diff(np.append(head, len(at))))


class Equal:
    """The distinct strings of a piece, found by their corpus order, a batch of text at a time."""

    def __init__(self, length: int):
        self.length, self.held, self.size = length, [], 0
        self.found, self.several = [], []

    def add(self, g: Parsed, at: np.ndarray, whole: np.ndarray) -> None:
        if len(at):
            order = np.argsort(at)
            at = at[order]
            self.held.append((*g.regions(at), g.strings(at), whole[order]))
            self.size += len(self.held[-1][0])
            if self.size >= ORDER_BYTES:
                self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        base = np.cumsum([0, *(len(x[0]) for x in self.held)])
        text = np.concatenate([x[0] for x in self.held])
        first, last = (np.concatenate([x[1][k] + b for x, b in zip(self.held, base)]) for k in (0, 1))
        triggers, at = (np.concatenate([x[k] + b for x, b in zip(self.held, base)]) for k in (2, 3))
        group = suffix_order.CorpusOrder(text, (first, last), triggers, TRIGGER, at, self.length).groups()
        _, one, count = np.unique(group, return_index=True, return_counts=True)
        self.found.append(runtime.Pairs.joined([x[4] for x in self.held]).take(one))
        self.several.append((count > 1) | (np.bincount(group, np.concatenate([x[5] for x in self.held])) > 0))
        self.held, self.size = [], 0

    def distinct(self) -> tuple["runtime.Pairs", np.ndarray]:
        """(strings, whether they are already known to be repeats)."""
        self.flush()
        found, several = runtime.Pairs.joined(self.found), joined(self.several, bool)
        one, inverse, count = found.distinct()
        return found.take(one), (count > 1) | (np.bincount(inverse, several, len(one)) > 0)


def parsed(table: pa.Table, length: int):
    """(ordered table, data, offsets, its groups one by one)."""
    table = runtime.ordered(table)
    data, offsets = runtime.text_arrays(table.column("text"))

    def groups():
        for a, b in runtime.slices(offsets, GROUP_BYTES):
            low, high = int(offsets[a]), int(offsets[b])
            if high - low <= 2 * GROUP_BYTES or b - a > 1:
                if high - low >= length:
                    yield Parsed(data[low:high], offsets[a : b + 1] - low, low, (0, high - low), length)
                continue
            for s in range(low, high, GROUP_BYTES):
                e = min(s + GROUP_BYTES, high)
                x, y = max(low, s - REACH), min(high, e + length + REACH + TRIGGER)
                yield Parsed(data[x:y], np.array([0, y - x]), x, (s - x, e - x), length)

    return table, data, offsets, groups


def keys(hashes: np.ndarray, n: int) -> np.ndarray:
    return runtime.bucket_of(hashes, n).astype(np.uint64) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def bits(column, sizes: list[int]) -> np.ndarray:
    return joined([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=k) for x, k in zip(column, sizes)], np.uint8)


def numbers(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def told(right: pa.Table, column: str, kind) -> np.ndarray:
    return joined(numbers(right.column(column).drop_null(), kind), kind)


def rows(piece: int | None, buckets: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """Blobs, one row a bucket, from arrays that stand in order of their bucket; booleans are packed."""
    parts = runtime.by_bucket(buckets)[1]
    blob = lambda x: np.packbits(x).tobytes() if x.dtype == bool else x.tobytes()
    out = {"bucket": pa.array([b for b, _, _ in parts], pa.int32()), "piece": pa.array([piece] * len(parts), pa.int32())}
    return pa.table(out | {name: pa.array([blob(x[i:j]) for _, i, j in parts], pa.binary()) for name, x in columns.items()})


def replies(table: pa.Table, hits: list[np.ndarray], checks: list[np.ndarray] | None = None, states: list[np.ndarray] | None = None) -> pa.Table:
    """What a bucket tells its pieces; booleans are packed."""
    blob = lambda x: np.packbits(x).tobytes() if x.dtype == bool else x.tobytes()
    blobs = lambda parts: pa.array([blob(x) for x in parts], pa.binary()) if parts else pa.nulls(len(hits), pa.binary())
    out = {c: pa.array(table.column(c).to_pylist(), pa.int32()) for c in ("piece", "bucket")}
    return pa.table(out | {"hits": blobs(hits), "checks": blobs(checks), "states": blobs(states)}).filter(pa.array([len(x) > 0 for x in hits], pa.bool_()))


def remove_repeats(documents: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: n_bytes, n_removed, the maximal removed runs (bytes, ends exclusive), and the kept bytes."""
    if length < 2 * REACH + TRIGGER:
        raise ValueError(f"length must be at least {2 * REACH + TRIGGER}")
    spark = documents.sparkSession
    n = runtime.pieces(spark, documents, text_col)
    docs = runtime.in_pieces(documents, n, id_col, text_col)

    def parse(table: pa.Table) -> pa.Table:
        piece = table.column("piece")[0].as_py()
        key, count = np.unique(keys(joined([g.parse_suffixes() for g in parsed(table, length)[3]()]), n), return_counts=True)
        return rows(piece, (key >> np.uint64(32)).astype(np.int64), {"low": key.astype(np.uint32), "several": count > 1})

    def repeated(table: pa.Table) -> pa.Table:
        """To each piece its parse suffixes that occur twice or more."""
        bucket, low = table.column("bucket")[0].as_py(), numbers(table.column("low"), np.uint32)
        every, inverse, count = np.unique(joined(low, np.uint32), return_inverse=True, return_counts=True)
        good = every[(count > 1) | (np.bincount(inverse, bits(table.column("several"), [len(x) for x in low]), len(every)) > 0)]
        return replies(table, [x[runtime.member_of(x, good)].astype(np.uint64) | np.uint64(bucket << 32) for x in low])

    def extend(table: pa.Table, right: pa.Table) -> pa.Table:
        """A piece's repeated parse suffixes with the phrase in front and all bytes behind."""
        piece, key, context = None, [], []
        if table.num_rows and right.num_rows:
            piece, hits = table.column("piece")[0].as_py(), np.sort(told(right, "hits", np.uint64))
            for g in parsed(table, length)[3]():
                k = keys(g.parse_suffixes(), n)
                which = np.flatnonzero(runtime.member_of(k, hits))
                key.append(k[which])
                context.append(g.contexts(which))
        key, context = joined(key), runtime.Pairs.joined(context)
        order = np.lexsort((context.b, context.a, key))
        key, context = key[order], context.take(order)
        head = np.flatnonzero(runtime.changes(key) | context.changes())
        count = np.diff(np.append(head, len(key)))
        return rows(piece, (key[head] >> np.uint64(32)).astype(np.int64), {"low": key[head].astype(np.uint32), "context": context.a[head], "check": context.b[head], "several": count > 1})

    def neighbours(table: pa.Table) -> pa.Table:
        """To each piece its contexts that are repeats as a whole, and those whose parse suffix has other contexts."""
        low, context, check = (numbers(table.column(c), t) for c, t in (("low", np.uint32), ("context", np.uint64), ("check", np.uint32)))
        sizes = [len(x) for x in context]
        low, context = joined(low, np.uint32), runtime.Pairs(joined(context), joined(check, np.uint32))
        several = bits(table.column("several"), sizes).astype(bool)
        order = np.lexsort((context.b, context.a, low))
        new_low = runtime.changes(low[order])
        new = new_low | context.take(order).changes()
        which, group = np.cumsum(new) - 1, np.cumsum(new_low) - 1
        whole = (np.bincount(which) > 1) | (np.bincount(which, several[order]) > 0)
        mixed = np.bincount(group, new) > 1
        state = np.zeros(len(low), np.uint8)
        state[order] = whole[which] * WHOLE + mixed[group] * OPEN
        cut = np.cumsum(sizes)[:-1]
        state = np.split(state, cut)
        told_ = lambda x: [y[s > 0] for y, s in zip(np.split(x, cut), state)]
        return replies(table, told_(context.a), told_(context.b), [s[s > 0] for s in state])

    def states(right: pa.Table):
        """The contexts told, each once, and their states; a context under several parse suffixes gets all its states."""
        marked = right.filter(pa.compute.is_valid(right.column("states")))
        context, state = runtime.Pairs(told(marked, "hits", np.uint64), told(marked, "checks", np.uint32)), told(marked, "states", np.uint8)
        one, inverse, _ = context.distinct()
        every = np.zeros(len(one), np.uint8)
        np.bitwise_or.at(every, inverse, state)
        return context.take(one), every

    def starts(g: Parsed, context: "runtime.Pairs", state: np.ndarray):
        """(state of each phrase, starts at which every string counts, whether each lies in a whole repeat)."""
        found = context.find(g.contexts())
        mark = np.where(found >= 0, np.append(state, np.uint8(0))[found], np.uint8(0))
        open_ = np.flatnonzero(mark & OPEN)
        at = spread(g.low[open_], g.high[open_])
        whole = np.repeat((mark[open_] & WHOLE) > 0, np.maximum(g.high[open_] - g.low[open_] + 1, 0))
        far = spread(g.far_low, g.far_high)
        return mark, np.concatenate([at, far]), np.concatenate([whole, np.zeros(len(far), bool)])

    def strings(table: pa.Table, right: pa.Table) -> pa.Table:
        """A piece's distinct strings where every start counts, and which it already knows to be repeats."""
        piece, found = None, Equal(length)
        if table.num_rows:
            piece = table.column("piece")[0].as_py()
            context, state = states(right)
            for g in parsed(table, length)[3]():
                found.add(g, *starts(g, context, state)[1:])
        every, several = found.distinct()
        bucket = runtime.bucket_of(every.a, n)
        return rows(piece, bucket, {"string": every.a, "check": every.b, "several": several})

    def equal(table: pa.Table) -> pa.Table:
        """To each piece which of its strings are repeats, in the order in which it sent them."""
        string = numbers(table.column("string"), np.uint64)
        sizes = [len(x) for x in string]
        string = runtime.Pairs(joined(string), joined(numbers(table.column("check"), np.uint32), np.uint32))
        several = bits(table.column("several"), sizes).astype(bool)
        one, inverse, count = string.distinct()
        good = ((count > 1) | (np.bincount(inverse, several, len(one)) > 0))[inverse]
        return replies(table, np.split(good, np.cumsum(sizes)[:-1]))

    def remove(table: pa.Table, right: pa.Table) -> pa.Table:
        run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in (("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("removed", run), ("kept", pa.binary()))})
        table, data, offsets, groups = parsed(table, length)
        context, state = states(right)
        first, last, single, hashes = [], [], [], []
        for g in groups():
            mark, at, _ = starts(g, context, state)
            covered = np.flatnonzero(mark & WHOLE)
            first.append(g.low[covered] + g.base)
            last.append(g.high[covered] + g.base)
            single.append(at + g.base)
            hashes.append(g.strings(at))
        # the same distinct strings in the same order as were sent
        hashes = runtime.Pairs.joined(hashes)
        one, inverse, _ = hashes.distinct()
        repeats = np.zeros(len(one), bool)
        edges = np.searchsorted(runtime.bucket_of(hashes.a[one], n), np.arange(n + 1))
        right = right.filter(pa.compute.is_null(right.column("states")))
        for bucket, blob in zip(right.column("bucket").to_pylist(), right.column("hits")):
            x, y = edges[bucket], edges[bucket + 1]
            repeats[x:y] = np.unpackbits(np.frombuffer(blob.as_buffer(), np.uint8), count=y - x)
        single = joined(single, np.int64)[repeats[inverse]]
        a = np.concatenate([joined(first, np.int64), single])
        b = np.concatenate([joined(last, np.int64), single]) + length
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order]) if len(a) else b
        # runs end at gaps, and where a document ends
        doc = np.searchsorted(offsets, a, side="right") - 1
        new = np.concatenate(([True], (a[1:] > b[:-1]) | (doc[1:] != doc[:-1]))) if len(a) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        starts_, ends_, owner = a[head], b[np.append(head[1:], len(a)) - 1] if len(a) else a, doc[head]
        at = np.searchsorted(owner, np.arange(len(offsets)))
        raw, removed, kept, gone = data.tobytes(), [], [], []
        for d in range(len(offsets) - 1):
            low, high = int(offsets[d]), int(offsets[d + 1])
            spans = list(zip(starts_[at[d] : at[d + 1]].tolist(), ends_[at[d] : at[d + 1]].tolist()))
            removed.append([{"start": s - low, "end": e - low} for s, e in spans])
            gone.append(sum(e - s for s, e in spans))
            kept.append(b"".join(raw[x:y] for x, y in zip([low, *[e for _, e in spans]], [*[s for s, _ in spans], high])))
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(gone, pa.int64()), "removed": pa.array(removed, run), "kept": pa.array(kept, pa.binary())})

    parses = docs.groupBy("piece").applyInArrow(runtime.lean(parse), "bucket int, piece int, low binary, several binary")
    twice = parses.groupBy("bucket").applyInArrow(runtime.lean(repeated), HIT)
    contexts = docs.groupBy("piece").cogroup(twice.groupBy("piece")).applyInArrow(runtime.lean_pair(extend), "bucket int, piece int, low binary, context binary, check binary, several binary")
    marked = runtime.written(contexts.groupBy("bucket").applyInArrow(runtime.lean(neighbours), HIT), "contexts")
    compared = docs.groupBy("piece").cogroup(marked.groupBy("piece")).applyInArrow(runtime.lean_pair(strings), "bucket int, piece int, string binary, check binary, several binary")
    same = compared.groupBy("bucket").applyInArrow(runtime.lean(equal), HIT)
    return docs.groupBy("piece").cogroup(marked.unionByName(same).groupBy("piece")).applyInArrow(runtime.lean_pair(remove), OUT)


def op4_suffix_dedup(spark, sf_dir):
    out = remove_repeats(runtime.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def oracle(length: int = LENGTH) -> str:
    """The definition in DuckDB, over two hexadecimal digits a byte: every string, the starts of those found twice, the runs they cover."""
    n = length
    return f"""
WITH a AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, i, md5_number(substr(x, 2 * i + 1, {2 * n})) AS m FROM (SELECT r, x, unnest(range(0, length(x) // 2 - {n - 1})) AS i FROM a WHERE length(x) >= {2 * n})),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY m) AS c FROM w) WHERE c > 1),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {n} THEN 0 ELSE 1 END AS new FROM s)),
p AS (SELECT r, run, min(i) AS a, max(i) + {n} AS b FROM g GROUP BY r, run),
q AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM p),
k AS (SELECT a.r, sum(b - q.a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (q.a - before)), '' ORDER BY q.a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM a JOIN q USING (r) GROUP BY a.r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM a LEFT JOIN k USING (r)
"""
