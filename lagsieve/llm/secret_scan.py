"""Secrets in texts: fixed patterns, and a token-efficiency test for random strings.

A maximal run of 20 or more characters of `[A-Za-z0-9+/_=-]` is a candidate. It
is random if a public byte-level vocabulary needs so many tokens for it that
there are fewer than `ratio` characters a token. Known digests (hexadecimal of
a digest's length, UUIDs) and identifiers (words and numbers joined by `_`, `-`
or `/`, camel case, plain numbers) are not candidates; a long word counts as one
only if it has that many characters a token itself, so a run of one case is no
identifier for its case. In a run that isn't random, what is left without the
words at its ends is tested, and then each part of 20 characters between
separators: words joined to a secret don't hide it.

Offsets are code points, ends exclusive. One narrow Arrow stage: no shuffle.
Null and empty texts have no spans. Repeated rows are scanned each; other
columns of the input are ignored; an empty table gives no rows; very long
texts are scanned whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

KINDS = ("assign", "access", "hex", "random")
# The three base patterns.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24, "random": 20}
RATIO = 2.0
# Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"
IDENTIFIER = r"[_/+=-]*(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[_/+=-]+|$)|(?:[A-Z][a-z]{2,})+(?:[_/+=-]+|$))*"
CAMEL = r"(?:[A-Z][a-z]{2,}){2,}"
PART = rf"(?<![A-Za-z0-9]){UUID}(?![A-Za-z0-9])|[A-Za-z0-9]+"
#: Letters of a word that must show by its tokens that it is one.
LONG_WORD = 8
#: Bytes of text that are scanned at a time.
SLICE_BYTES = 1 << 19
SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"


def long_runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Where runs of at least `least` true values start; a document's edge ends a run."""
    first = np.zeros(len(inside) + 1, bool)
    first[offsets] = True
    off = np.concatenate(([True], ~inside, [True]))
    starts = np.flatnonzero(inside & (off[:-2] | first[:-1]))
    ends = np.flatnonzero(inside & (off[2:] | first[1:])) + 1
    return starts[ends - starts >= least]


def byte_class(letters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(letters)] = True
    return out


class Scanner:
    def __init__(self, vocabulary: str, pattern: str, ratio: float):
        import base64

        import tiktoken

        with open(runtime.vocabulary(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ratio = ratio
        self.assign, self.access, self.hex = re.compile(ASSIGN), re.compile(ACCESS), re.compile(f"{HEX[:-1]}{{{LEAST['hex']},}}")
        self.run = re.compile(f"[A-Za-z0-9+/_=-]{{{LEAST['random']},}}")
        self.known = re.compile(rf"(?:{UUID}|{IDENTIFIER})\Z")
        self.uuid, self.camel, self.part = re.compile(rf"{UUID}\Z"), re.compile(rf"{CAMEL}\Z"), re.compile(PART)
        self.word = re.compile(f"[A-Za-z]{{{LONG_WORD},}}")
        self.digest = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
        self.hex_bytes = byte_class(b"0123456789abcdef")
        self.run_bytes = byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")

    def is_known(self, s: str) -> bool:
        """A digest, a UUID, or an identifier whose long words have the tokens of words."""
        if self.digest.match(s) and len(s) in DIGEST_LENGTHS or self.uuid.match(s):
            return True
        if not self.known.match(s):
            return False
        words = [w for w in self.word.findall(s) if not self.camel.match(w)]
        return sum(map(len, words)) >= self.ratio * sum(len(self.encode(w)) for w in words)

    def is_random(self, s: str) -> bool:
        return not self.is_known(s) and len(s) < self.ratio * len(self.encode(s))

    def random_spans(self, s: str, at: int) -> list[tuple[int, int]]:
        """Of a run that starts at `at`: the whole, or what its outer words leave, or the parts between separators that are random."""
        if self.is_random(s):
            return [(at, at + len(s))]
        parts = [m.span() for m in self.part.finditer(s)]
        if len(parts) == 1 and parts[0] == (0, len(s)):
            return []
        inner = [not self.is_known(s[a:b]) for a, b in parts]
        if True not in inner:
            return []
        a, b = parts[inner.index(True)][0], parts[len(parts) - 1 - inner[::-1].index(True)][1]
        if b - a >= LEAST["random"] and self.is_random(s[a:b]):
            return [(at + a, at + b)]
        return [(at + a, at + b) for a, b in parts if b - a >= LEAST["random"] and self.is_random(s[a:b])]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        out = [("assign", m.start(), m.end()) for m in self.assign.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
        out += [("access", m.start(), m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
        out += [("hex", m.start(), m.end()) for m in self.hex.finditer(text)]
        out += [("random", a, b) for m in self.run.finditer(text) for a, b in self.random_spans(m.group(), m.start())]
        return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which documents may have a span: by runs of bytes, and by keywords."""
        n = len(offsets) - 1
        out = np.zeros(n, bool)
        for inside, least in ((self.hex_bytes[data], LEAST["hex"]), (self.run_bytes[data], LEAST["random"])):
            out[np.searchsorted(offsets, long_runs(inside, offsets, least), side="right") - 1] = True
        raw = data.tobytes().lower()
        for word in (b"passw", b"secret", b"token", b"api"):
            at = raw.find(word)
            while at >= 0:
                doc = int(np.searchsorted(offsets, at, side="right")) - 1
                out[doc] = True
                at = raw.find(word, int(offsets[doc + 1]))
        return np.flatnonzero(out)


def scan(documents: DataFrame, *, vocabulary: str = "byte_bpe_50k.tiktoken", pattern: str | None = None, ratio: float = RATIO, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), redact: str | None = None) -> DataFrame:
    """doc_id and its spans, by start and kind; with `redact`, also a struct `kept` of the columns of `keep`, where the text has each span replaced."""
    others = [c for c in keep if c != text_col]  # the text goes to the workers and back once
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(others)])

    def run(batches):
        runtime.fresh("secret scanners")
        state = runtime.worker_state("secret scanners")
        if (vocabulary, pattern, ratio) not in state:
            import public_tokenizers

            state[vocabulary, pattern, ratio] = Scanner(vocabulary, pattern or public_tokenizers.PATTERN, ratio)
        scanner = state[vocabulary, pattern, ratio]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = batch.column(1)
            data, offsets = runtime.text_arrays(texts)
            for a, b in runtime.slices(offsets, SLICE_BYTES):
                found, changed = [[] for _ in range(b - a)], {}
                for i in scanner.candidates(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).tolist():
                    text = texts[a + i].as_py() or ""
                    spans = scanner.spans(text)
                    found[i] = [{"kind": k, "start": s, "end": e} for k, s, e in spans]
                    if spans and redact is not None:
                        changed[i] = redacted(text, spans, redact)
                columns = [batch.column(0).slice(a, b - a), pa.array(found, kind)]
                if redact is not None:
                    part = texts.slice(a, b - a)
                    if changed:
                        part = pa.array([changed.get(i, t) for i, t in enumerate(part.to_pylist())], texts.type)
                    columns += [part, *[batch.column(2 + i).slice(a, b - a) for i in range(len(others))]]
                names = ["doc_id", "spans", "_text", *[f"_keep_{i}" for i in range(len(others))]][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            batch = texts = data = offsets = columns = part = None  # gone before the next one is read
            runtime.trim()

    if redact is None:
        return rows.select("doc_id", "_text").mapInArrow(run, SPANS)
    schema = f"{SPANS}, _text string" + "".join(f", _keep_{i} {documents.schema[c].dataType.simpleString()}" for i, c in enumerate(others))
    out = rows.mapInArrow(run, schema)
    place = {c: f"_keep_{i}" for i, c in enumerate(others)} | {text_col: "_text"}
    return out.select("doc_id", "spans", F.struct(*[F.col(place[c]).alias(c) for c in keep]).alias("kept"))


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with each union of overlapping spans replaced by the mark."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans: str, kinds: tuple[str, ...] = KINDS) -> str:
    """SQL: kind:start:end of the spans of these kinds, joined by commas."""
    some = ", ".join(f"'{k}'" for k in kinds)
    return f"concat_ws(',', transform(filter({spans}, s -> s.kind IN ({some})), s -> concat(s.kind, ':', s.start, ':', s.end)))"


def op5_secret_scan(spark, sf_dir):
    found = scan(runtime.table(spark, sf_dir, "documents"))
    count = lambda k: F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(F.expr(joined("spans", KINDS[:3])), 256).alias("base_sha256"), F.expr(joined("spans")).alias("spans"), count("random").alias("n_random"))
