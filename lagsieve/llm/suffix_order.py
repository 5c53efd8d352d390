"""Corpus order of text by prefix-free parsing: suffix arrays of the dictionary and of the parse, combined.

A text is a set of regions, none of which goes on in another. Triggers (hashes
of `w` bytes that meet a condition) cut each region into phrases; a phrase goes
from one trigger to the end of the next, so neighbours share `w` bytes and no
phrase's longer suffix is the beginning of another's: the phrases are
prefix-free. A region's last phrase goes to its end.

* The dictionary holds each distinct phrase once. The suffixes of its phrases
  are ranked by prefix doubling (`Dictionary.levels`); that is its suffix array.
* The parse is the regions' phrases by rank. Its suffixes are ranked in the
  same way (`Parse.levels`).
* The suffix at byte i is a dictionary suffix followed by the parse from the
  next phrase on. Sorted by both ranks, the suffixes of the whole text are in
  corpus order, though only the dictionary and the parse, which are far smaller
  than repetitive text, were sorted. Longest common prefixes of neighbours come
  from the ranks kept at each doubling.

Only what agrees over `length` bytes matters here, so ranks stop there.
"""

from __future__ import annotations

import numpy as np

#: Bytes that the first ranks are made of: 7 symbols of 9 bits (0 is the end).
PACKED = 7


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 of values."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int32)


def doubled(rank: np.ndarray, step: int, more: np.ndarray) -> np.ndarray:
    """Ranks over twice as much: by the rank, then by that `step` further on, where there is more."""
    behind = np.zeros(len(rank), np.int64)
    behind[: max(len(rank) - step, 0)] = rank[step:]
    return dense(rank * np.int64(len(rank) + 2) + np.where(more, behind + 1, 0))


class Dictionary:
    """Distinct phrases one after the other, and the ranks of all their suffixes."""

    def __init__(self, phrases: list[bytes], length: int):
        sizes = np.fromiter(map(len, phrases), np.int64, len(phrases))
        self.data = np.frombuffer(b"".join(phrases), np.uint8)
        self.starts = np.cumsum(sizes) - sizes
        self.left = left = np.repeat(self.starts + sizes, sizes) - np.arange(len(self.data))
        symbol = np.concatenate([self.data.astype(np.int64) + 1, np.zeros(PACKED, np.int64)])
        key = np.zeros(len(self.data), np.int64)
        for j in range(PACKED):
            key = key << 9 | np.where(left > j, symbol[j : j + len(key)], 0)
        self.span, self.levels = [PACKED], [dense(key)]
        longest = int(sizes.max()) if len(sizes) else 0
        while self.span[-1] < min(length, longest):
            self.levels.append(doubled(self.levels[-1], self.span[-1], left > self.span[-1]))
            self.span.append(2 * self.span[-1])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes different suffixes share."""
        a, b, n = a.copy(), b.copy(), len(self.data)
        out = np.zeros(len(a), np.int64)
        for rank, span in zip(self.levels[::-1], self.span[::-1]):
            same = (a < n) & (b < n)
            same[same] = rank[a[same]] == rank[b[same]]
            a[same] += span
            b[same] += span
            out[same] += span
        for _ in range(PACKED - 1):
            same = (a < n) & (b < n)
            same[same] = self.data[a[same]] == self.data[b[same]]
            if not same.any():
                break
            # a byte that differs ends the comparison
            a, b = np.where(same, a + 1, n), np.where(same, b + 1, n)
            out[same] += 1
        return out


class Parse:
    """Phrases of all regions by rank, and the ranks of all suffixes of that."""

    def __init__(self, rank: np.ndarray, end: np.ndarray, length: int):
        """end: the number of the phrase behind the last of the same region."""
        self.end, self.length, self.levels, step = end, length, [dense(rank)], 1
        at = np.arange(len(rank))
        while len(rank) and step < length:  # each phrase goes on by a byte at least
            new = doubled(self.levels[-1], step, at + step < end)
            if new.max() == self.levels[-1].max():
                break  # nothing more to tell apart
            self.levels.append(new)
            step *= 2

    def skip(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of parse suffixes, beyond the phrases that they share (or as many as are sure to have `length` bytes)."""
        p, q = p.copy(), q.copy()
        top, limits = len(self.levels) - 1, np.append(self.end, 0)
        end_p, end_q = limits[np.minimum(p, len(self.end))], limits[np.minimum(q, len(self.end))]
        for level in range(top, -1, -1):
            for _ in range(1 + self.length // (1 << top) if level == top else 1):
                go = (p < end_p) & (q < end_q)
                go[go] = self.levels[level][p[go]] == self.levels[level][q[go]]
                if not go.any():
                    break
                p[go] += 1 << level
                q[go] += 1 << level
        return p, q


class CorpusOrder:
    """The suffixes at some bytes of a text in corpus order, and which neighbours agree over `length` bytes.

    regions: starts and ends, one behind the other; triggers: their starts, in
    order, each within a region; at: starts of strings of `length` bytes within
    a region.
    """

    def __init__(self, data: np.ndarray, regions: tuple[np.ndarray, np.ndarray], triggers: np.ndarray, w: int, at: np.ndarray, length: int):
        first, last = regions
        start = np.union1d(first, triggers)
        region = np.searchsorted(first, start, side="right") - 1
        n = len(start)
        end_of = np.searchsorted(region, region, side="right")  # behind the region's last phrase
        behind = np.append(start, 0)[np.minimum(np.arange(n) + 1, n)]
        end = np.where(np.arange(n) + 1 < end_of, np.minimum(behind + w, last[region]), last[region])
        raw, known = data.tobytes(), {}
        name = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist())), np.int64, n)
        self.dictionary = Dictionary(list(known), length + w)
        self.parse = Parse(self.dictionary.levels[-1][self.dictionary.starts[name]] if n else name, end_of, length)
        phrase = np.searchsorted(start, at, side="right") - 1
        inside = self.dictionary.starts[name[phrase]] + at - start[phrase]
        head = self.dictionary.levels[-1][inside] if n else inside
        follows = phrase + 1 < end_of[phrase]
        tail = np.where(follows, np.append(self.parse.levels[-1], 0)[np.minimum(phrase + 1, n)] + 1, 0)
        self.order = np.lexsort((tail, head))
        # common prefixes of neighbours
        i, j = self.order[:-1], self.order[1:]
        same_head = head[i] == head[j]
        p, q = self.parse.skip(np.where(follows[i], phrase[i] + 1, n), np.where(follows[j], phrase[j] + 1, n))
        over = (p >= end_of[phrase[i]]) | (q >= end_of[phrase[j]])
        # where the phrases part: in the middle of the first, or of the first that differ
        p, q = np.minimum(p, n - 1), np.minimum(q, n - 1)
        self.apart = np.where(same_head, self.dictionary.starts[name[p]], inside[i]), np.where(same_head, self.dictionary.starts[name[q]], inside[j])
        self.done = np.where(same_head, start[p] - at[i], 0)
        self.equal = (same_head & over) | (self.done >= length)  # up to a region's end, which lies `length` bytes behind
        a, b = self.apart
        open_ = np.flatnonzero(~self.equal & (self.done + np.minimum(self.dictionary.left[a], self.dictionary.left[b]) >= length))
        self.equal[open_] = self.done[open_] + self.dictionary.common(a[open_], b[open_]) >= length

    def common(self) -> np.ndarray:
        """The longest common prefixes of neighbours that aren't equal."""
        return self.done + self.dictionary.common(*self.apart)

    def groups(self) -> np.ndarray:
        """A number for each string, the same for equal strings."""
        out = np.zeros(len(self.order), np.int64)
        if len(self.order):
            out[self.order] = np.cumsum(np.concatenate(([True], ~self.equal))) - 1
        return out
