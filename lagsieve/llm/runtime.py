"""What the text operators share: shared folders, Arrow text slices, hashes, per-worker state.

The Python functions of this package are pickled by value, so executors need
only numpy, pyarrow and the tokenizer libraries, not a copy of the package.
"""

from __future__ import annotations

import os
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
SLICE_BYTES = 4 << 20

#: Rows without a doc_id come last wherever documents are ordered by it.
NO_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only where all of them are one process (local mode) may it be unnamed."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        state = worker_state("shared")
        base = state.setdefault("dir", tempfile.mkdtemp(prefix="lagsieve-"))
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: the rows as a Parquet table in the shared folder, read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    worker_state("tables").setdefault("paths", []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, keep: DataFrame | None = None) -> None:
    """Delete the tables that were written so far, when nothing will be read from them any more; but for the one that `keep` reads."""
    paths = worker_state("tables").setdefault("paths", [])
    needed = {os.path.dirname(f) for f in keep.inputFiles()} if keep is not None else set()
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    left = []
    for path in paths:
        place = hadoop(path)
        if any(x.endswith(f"/{place.getName()}") for x in needed):
            left.append(path)
        else:
            place.getFileSystem(conf).delete(place, True)
    paths[:] = left


def worker_state(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    module = sys.modules.setdefault("_lagsieve_worker", types.ModuleType("_lagsieve_worker"))
    return module.__dict__.setdefault(name, {})


def fresh(*names: str) -> None:
    """Drop what other operators have left in this worker, which serves one after another; the states named stay."""
    module = sys.modules.get("_lagsieve_worker")
    for name in [k for k, v in vars(module).items() if isinstance(v, dict) and k not in (*names, "libc", "shared", "tables") and not k.startswith("__")] if module else []:
        del module.__dict__[name]
    trim()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, on whatever machine asks."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def trim() -> None:
    """Give free memory back to the system: a worker lives on, and its heap would stay at its peak."""
    import ctypes

    pa.default_memory_pool().release_unused()
    state = worker_state("libc")
    if "trim" not in state:
        try:
            state["trim"] = ctypes.CDLL("libc.so.6").malloc_trim
        except (OSError, AttributeError):  # another C library: its own affair
            state["trim"] = lambda pad: 0
    state["trim"](0)


def lean(f):
    """A function of one Arrow table (a group) that leaves no free memory behind."""

    def run(table):
        try:
            return f(table)
        finally:
            trim()

    return run


def lean_pair(f):
    """The same of two tables (a cogroup)."""

    def run(left, right):
        try:
            return f(left, right)
        finally:
            trim()

    return run


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets); null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def id_array(column: pa.Array) -> np.ndarray:
    """Integer ids; null ids become NO_ID."""
    return pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """(first, last) document numbers of runs of about `most` bytes."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words `[^\\x20\\x09-\\x0D]+`, and each document's first word number (n + 1 entries)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SEPARATOR[data]
    # a document's edge ends a word even where no white space stands
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n + 1 powers of an odd base modulo 2^64 and of its inverse; kept by the worker and grown as needed."""
    state = worker_state("powers")
    if seed not in state or len(state[seed][0]) <= n:
        size = max(n + 1, 1 << 16)
        base = (0x9E3779B97F4A7C15 * (2 * seed + 1)) & ((1 << 64) - 1) | 5
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        state[seed] = tuple(both)
    up, down = state[seed]
    return up[: n + 1], down[: n + 1]


class Rolling:
    """Hashes of arbitrary stretches of one sequence, from prefix sums of a polynomial modulo 2^64.

    values are 64-bit numbers (mixed bytes or word hashes); a stretch's hash
    depends on its values and their order alone. Each `seed` is an independent
    family.
    """

    def __init__(self, values: np.ndarray, seed: int = 1):
        n = len(values)
        up, self.inverse = powers(seed, n)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.prefix[1:])

    def of(self, starts: np.ndarray, lengths) -> np.ndarray:
        """Mixed hashes of [start, start + length)."""
        return mix((self.prefix[starts + lengths] - self.prefix[starts]) * self.inverse[starts])

    def windows(self, n: int) -> np.ndarray:
        """Mixed hashes of all windows of n values."""
        k = len(self.prefix) - n
        return mix((self.prefix[n:] - self.prefix[:k]) * self.inverse[:k]) if k > 0 else np.zeros(0, np.uint64)


def changes(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it; the first does."""
    return np.concatenate((np.ones(min(len(values), 1), bool), values[1:] != values[:-1]))


class Pairs:
    """Hashes in two parts. The first (64 bits) alone nearly always tells them apart; where it doesn't, the second does."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b

    def __len__(self) -> int:
        return len(self.a)

    @staticmethod
    def joined(parts: list[Pairs]) -> Pairs:
        if not parts:
            return Pairs(np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        return Pairs(np.concatenate([x.a for x in parts]), np.concatenate([x.b for x in parts]))

    def take(self, which) -> Pairs:
        return Pairs(self.a[which], self.b[which])

    def changes(self) -> np.ndarray:
        return changes(self.a) | changes(self.b)

    def sorting(self) -> np.ndarray:
        order = np.argsort(self.a, kind="stable")
        a, b = self.a[order], self.b[order]
        return np.lexsort((self.b, self.a)) if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any() else order

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(one of each in sorted order, which of these each is, how many there are)."""
        order = self.sorting()
        head = np.flatnonzero(self.take(order).changes())
        count = np.diff(np.append(head, len(order)))
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.repeat(np.arange(len(head)), count)
        return order[head], inverse, count

    def find(self, others: Pairs) -> np.ndarray:
        """Where others stand among these, which are sorted and distinct; -1 if they don't."""
        out = np.full(len(others), -1)
        if not len(self):
            return out
        at = np.searchsorted(self.a, others.a)
        most = int(np.diff(np.append(np.flatnonzero(changes(self.a)), len(self))).max())
        for k in range(most):  # once, but for hashes with the same first half
            x = np.minimum(at + k, len(self) - 1)
            hit = (self.a[x] == others.a) & (self.b[x] == others.b)
            out[hit] = x[hit]
        return out


def byte_values(seed: int) -> np.ndarray:
    """256 fixed random numbers, one a byte value."""
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1, most: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word's bytes, worked out over about `most` bytes at a time."""
    out, values, a = np.zeros(len(starts), np.uint64), byte_values(seed), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + most)))
        low = starts[a]
        out[a:b] = Rolling(values[data[low : ends[b - 1]]], seed).of(starts[a:b] - low, ends[a:b] - starts[a:b])
        a = b
    return out


def in_pieces(documents: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(piece, doc_id, text): each document in one of n pieces by its id; rows without an id are spread by their text."""
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    df = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return df.select(F.pmod(key, F.lit(n)).cast("int").alias("piece"), "doc_id", "text")


def ordered(table: pa.Table) -> pa.Table:
    """The rows of a piece by doc_id, so that every stage sees them in the same order."""
    return table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def bucket_of(high: np.ndarray, n: int) -> np.ndarray:
    """One of n buckets from a hash's upper 32 bits."""
    return ((high >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def by_bucket(buckets: np.ndarray):
    """(order, [(bucket, first, last)]): a stable order by bucket and each bucket's stretch of it."""
    order = np.argsort(buckets, kind="stable")
    cut = buckets[order]
    at = np.flatnonzero(np.diff(cut, prepend=-1))
    return order, list(zip(cut[at].tolist(), at.tolist(), [*at[1:].tolist(), len(cut)]))


def member_of(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def pieces(spark: SparkSession, documents: DataFrame, text: str, bytes_each: int = 6 << 20) -> int:
    """How many pieces of about `bytes_each` bytes the texts make: grows with the input, at least the session's partitions."""
    total = documents.select(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // bytes_each))
