"""Token counts of a unigram tokenizer without making its tokens: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary's pieces enumerates all matches
in a word; dynamic programming carries, for each position, the best score of a
segmentation that ends there and its number of pieces. Nothing else is kept: no
lattice, no back pointers.

The counts are those of the `tokenizers` library's Unigram model with byte
fallback over the same pieces and scores, behind a Metaspace pre-tokenizer:
scores add up in double precision; of equally good segmentations, the one whose
last piece starts first wins; a character that no one-character piece matches
costs the smallest score less 10 and counts as its UTF-8 bytes. Pieces don't
cross the space mark, so words are counted apart, and a worker remembers the
last `CACHE_WORDS` distinct ones. All pieces of the list can match, control,
unknown and byte pieces among them: a literal `</s>` in a text is one piece, as
it is to the library's model over that list.

Null and empty texts have no tokens. Repeated rows are counted each; other
columns are ignored; an empty table gives no rows; long texts and long words
are counted whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

SPACE = "▁"
CACHE_WORDS = 600_000
UNKNOWN_PENALTY = 10.0


class Counter:
    """Counts and scores of texts; words are remembered with and without a space mark in front."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.lines = not any("\n" in p for p, _ in pieces)
        self.known: dict[bool, dict[str, tuple[int, float]]] = {True: {}, False: {}}

    def word(self, text: str) -> tuple[int, float]:
        """(pieces, score) of one word by dynamic programming over the matches, which come by their ends, longest first."""
        best, count = [0.0] * (len(text) + 1), [0] * (len(text) + 1)
        at = 0  # ends below it are settled
        matches = self.automaton.iter(text)
        end, found = next(matches, (len(text), None))
        unknown = self.unknown
        while at < len(text):
            top, number, single = None, 0, False
            while end == at and found is not None:
                size, score = found
                start = at + 1 - size
                value = best[start] + score
                if top is None or value > top:
                    top, number = value, count[start] + 1
                single = single or size == 1
                end, found = next(matches, (len(text), None))
            if not single:
                value = best[at] + unknown
                if top is None or value > top:
                    top, number = value, count[at] + len(text[at].encode("utf-8"))
            at += 1
            best[at], count[at] = top, number
        return count[-1], best[-1]

    def learn(self, words: set[str], marked: bool) -> None:
        known = self.known[marked]
        new = words.difference(known)
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = words
        for w in new:
            known[w] = self.word(SPACE + w if marked else w)

    def __call__(self, texts: list[str]) -> tuple[list[int], list[float]]:
        split = []
        for text in texts:
            marked, bare, breaks = [], [], 0
            if text:
                lines = text.replace(" ", SPACE).split("\n") if self.lines else [text.replace(" ", SPACE)]
                breaks = len(lines) - 1
                for i, line in enumerate(lines):
                    head, *rest = line.split(SPACE)
                    marked += rest
                    if i:
                        bare.append(head)
                    elif head or not rest:
                        marked.append(head)
            split.append((marked, bare, breaks))
        self.learn(set().union(*[m for m, _, _ in split]), True)
        self.learn(set().union(*[b for _, b, _ in split]), False)
        a, b, counts, scores = self.known[True], self.known[False], [], []
        for marked, bare, breaks in split:
            found = [a[w] for w in marked] + [b[w] for w in bare]
            counts.append(sum([n for n, _ in found]) + breaks)
            scores.append(sum([s for _, s in found]) + breaks * self.unknown)
        return counts, scores


def pieces_of(vocabulary: str) -> list[tuple[str, float]]:
    """The pieces of a SentencePiece file and their scores, in order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def count_tokens(documents: DataFrame, *, vocabulary: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_tokens, score), a row for each row of the input. One narrow stage."""

    def run(batches):
        state = runtime.worker_state("unigram counters")
        if vocabulary not in state:
            state[vocabulary] = Counter(pieces_of(runtime.vocabulary(vocabulary)))
        for batch in batches:
            texts = batch.column(1)
            _, offsets = runtime.text_arrays(texts)
            for a, b in runtime.slices(offsets, 2 << 20):
                some = [t or "" for t in texts.slice(a, b - a).to_pylist()]
                counts, scores = state[vocabulary](some)
                yield pa.record_batch({"doc_id": batch.column(0).slice(a, b - a), "n_chars": pa.array([len(t) for t in some], pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "score": pa.array(scores, pa.float64())})

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_chars long, n_tokens long, score double")


def op1_token_counts(spark, sf_dir):
    return count_tokens(runtime.table(spark, sf_dir, "documents"))
