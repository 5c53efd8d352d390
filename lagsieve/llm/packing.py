"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task packs the documents of its input partition as they come, without a
shuffle. A document's full windows are cut off first; what is left goes into
the fill level that makes the sum of squared counts of partially filled
windows smallest (ties: the fullest level). The counts stand in a level array
of `window` entries, so memory doesn't grow with the input. At the end of a
task the windows still open are closed: the emptiest are dealt out, cut where
need be, into the gaps of the fullest, so that one window of a task at most has
padding.

Null and empty texts are a document of the end id alone. Repeated rows are
packed once each. Very long texts are tokenised whole and cut into windows.
Other columns of the input are ignored. An empty table gives no rows. doc_id may be null and is passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

WINDOW = 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Bytes of text that are tokenised at a time.
SLICE_BYTES = 1 << 20
#: Words whose ids a worker remembers; then it starts anew.
CACHE_WORDS = 450_000


#: A word of plain letters and then plain punctuation: two pre-tokens, unchanged by normalisation but for their case.
PLAIN = r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)\Z"


class WordTokenizer:
    """ids of a text as the concatenated ids of its words: the vocabulary's pre-tokenizer never joins across ASCII white space.

    Plain words go straight to the vocabulary's merges, all others through its
    whole normalisation; either way a worker remembers their ids.
    """

    def __init__(self, vocabulary: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.merge = self.tokenizer.model.tokenize
        self.plain = re.compile(PLAIN).match
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # letters for bytes, as the byte-level pre-tokenizer writes them: read off the two-byte letters of the plain class
        self.letters = {}
        for c in "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ":
            self.letters.update(zip(c.encode(), level.pre_tokenize_str(c)[0][0]))
        self.punctuation: dict[str, bytes] = {"": b""}
        self.known: dict[bytes, bytes] = {}

    def ids(self, run: str) -> bytes:
        return np.array([t.id for t in self.merge(run)], "<u4").tobytes()

    def learn(self, words) -> None:
        rest, known, punctuation = [], self.known, self.punctuation
        for w in words:
            m = self.plain(w.decode("utf-8"))
            if m is None:
                rest.append(w)
                continue
            letters, marks = m.groups()
            if marks not in punctuation:
                if len(punctuation) > 10_000:
                    punctuation.clear()
                    punctuation[""] = b""
                punctuation[marks] = self.ids(marks)
            letters = letters.lower()
            if not letters.isascii():
                letters = letters.encode("utf-8").decode("latin-1").translate(self.letters)
            known[w] = self.ids(letters) + punctuation[marks] if letters else punctuation[marks]
        for at in range(0, len(rest), 10_000):
            some = rest[at : at + 10_000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in some], add_special_tokens=False)):
                known[w] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        words = [t.split() for t in texts]
        known = self.known
        new = set().union(*words).difference(known) if words else set()
        if new:
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = set().union(*words)
            self.learn(new)
        return [b"".join([known[w] for w in ws]) for ws in words]


class Packer:
    """The level array, the open windows by level, and their pieces."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.by_level: dict[int, list[int]] = {}
        self.open: dict[int, list] = {}  # window number -> [fill, pieces]
        self.next = 0
        self.done: list[tuple] = []  # (doc, start, ids, doc_tokens, window, offset)

    def level(self, size: int) -> int:
        """The fill level for a piece; 0 is a new window."""
        room = self.window - size
        n = self.count
        after = 2 * n[size : self.window + 1] + 1
        after[room] = 0  # a full window no longer counts
        cost = after + np.where(n[: room + 1] > 0, 1 - 2 * n[: room + 1], 1 << 40)
        cost[0] = after[0]
        return room - int(np.argmin(cost[::-1]))

    def add(self, doc, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.window:
            self.done.append((doc, start, ids[4 * start : 4 * (start + self.window)], total, self.next, 0))
            self.next += 1
            start += self.window
        if start == total:
            return
        size = total - start
        at = self.level(size)
        if at:
            number = self.by_level[at].pop()
            self.count[at] -= 1
        else:
            number, self.next = self.next, self.next + 1
            self.open[number] = [0, []]
        fill, held = self.open[number]
        held.append((doc, start, ids[4 * start :], total, number, fill))
        fill += size
        if fill == self.window:
            self.done += held
            del self.open[number]
        else:
            self.open[number][0] = fill
            self.count[fill] += 1
            self.by_level.setdefault(fill, []).append(number)

    def close(self) -> None:
        """Deal the emptiest open windows out into the gaps of the fullest; what is left over fills one more."""
        order = sorted(self.open.items(), key=lambda kv: (-kv[1][0], kv[0]))
        full = sum(f for _, (f, _) in order) // self.window
        donors = [p for _, (_, held) in order[full:] for p in held]
        for number, (fill, held) in [*order[:full], *((n, (0, [])) for n, _ in order[full : full + 1])]:
            self.done += held
            while fill < self.window and donors:
                doc, start, ids, total, _, _ = donors.pop()
                take = min(self.window - fill, len(ids) // 4)
                self.done.append((doc, start, ids[: 4 * take], total, number, fill))
                fill += take
                if 4 * take < len(ids):
                    donors.append((doc, start + take, ids[4 * take :], total, number, 0))
        self.open.clear()
        self.by_level.clear()
        self.count[:] = 0


def pack(documents: DataFrame, *, vocabulary: str = "word_bpe_49k.json", window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start (ids of the document before it), length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset in the sequence."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        runtime.fresh("word tokenizers")
        state = runtime.worker_state("word tokenizers")
        if vocabulary not in state:
            state[vocabulary] = WordTokenizer(runtime.vocabulary(vocabulary))
        tokenizer, packer = state[vocabulary], Packer(window)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

        def ready(least: int):
            if len(packer.done) > least:
                doc, start, ids, total, number, offset = zip(*packer.done)
                packer.done = []
                yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array([base + x for x in number], pa.int64()), pa.array(offset, pa.int64())], schema=schema)

        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            offsets = runtime.text_arrays(texts)[1]
            for a, b in runtime.slices(offsets, SLICE_BYTES):
                raw = [x.encode("utf-8") if x else b"" for x in texts.slice(a, b - a).to_pylist()]
                for doc, ids in zip(docs[a:b], tokenizer(raw)):
                    packer.add(doc, ids + end)
                yield from ready(2000)
            batch = docs = texts = offsets = raw = None  # gone before the next one is read
            runtime.trim()
        packer.close()
        yield from ready(0)

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark, sf_dir):
    return digests(pack(runtime.table(spark, sf_dir, "documents")))
