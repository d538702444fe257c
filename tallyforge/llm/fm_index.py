"""FM-index of one shard: a text of word numbers that is searched backwards and located by sampled positions.

A shard holds the words of several texts, each closed by an end mark of its own. Suffixes are sorted by prefix
doubling. The symbols before the sorted suffixes lie in a wavelet matrix: one bit plane for each bit of a symbol, in
which ranks are counted. Positions are kept for every `STEP`-th word of a text, its first word included, so that
stepping back from any row meets a kept one before it would leave the text.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

STEP = 16
#: Bytes that are part of words (A-Z as a-z); all others part words.
FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def split_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (in lower case), digits and characters outside ASCII."""
    return text.translate(FOLD).split()


def sorted_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of an array of small whole numbers in which every text ends with a symbol that occurs once.

    The first sort compares as many symbols as fit into 62 bits; later ones double the depth and touch only
    suffixes that still share their rank with others.
    """
    n = len(symbols)
    bits = int(symbols.max()).bit_length() or 1
    depth = min(max(1, 62 // bits), n)
    key = np.zeros(n, np.int64)
    for i in range(depth):
        key <<= bits
        key[:n - i] |= symbols[i:]
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    todo, at = order, np.arange(n)
    compared = key[order]
    while True:
        # `todo` lie at the places `at`, in order of `compared`; a group is ranked by its first place
        first = np.concatenate(([True], compared[1:] != compared[:-1]))
        start = np.maximum.accumulate(np.where(first, at, 0))
        rank[todo] = start
        order[at] = todo
        alone = first & np.concatenate((first[1:], [True]))
        todo, at, start = todo[~alone], at[~alone], start[~alone]
        if not len(todo):
            return order
        compared = start * n + rank[todo + depth]
        again = np.argsort(compared)
        todo, compared = todo[again], compared[again]
        depth *= 2


class Shard:
    """The index over texts given as lists of words; `packed` and `unpacked` turn it into columns and back."""

    def __init__(self, vocabulary: dict[bytes, int], starts: np.ndarray, planes: np.ndarray, counts: np.ndarray,
                 marks: np.ndarray, kept: np.ndarray) -> None:
        self.vocabulary, self.starts, self.planes, self.counts, self.marks, self.kept = vocabulary, starts, planes, counts, marks, kept
        levels, self.n = len(planes), int(counts.sum())
        self.before = np.cumsum(counts) - counts  # rows of smaller symbols
        self.ranks = np.cumsum(np.bitwise_count(planes), axis=1, dtype=np.int64) - np.bitwise_count(planes)
        self.ones = np.bitwise_count(planes).sum(axis=1).astype(np.int64)
        self.mark_ranks = np.cumsum(np.bitwise_count(marks), dtype=np.int64) - np.bitwise_count(marks)
        turned = np.zeros(len(counts), np.int64)  # the last plane orders symbols by their bits read backwards
        for level in range(levels):
            turned |= ((np.arange(len(counts)) >> level) & 1) << (levels - 1 - level)
        by = np.argsort(turned)
        self.base = np.empty(len(counts), np.int64)
        self.base[by] = np.cumsum(counts[by]) - counts[by]

    @classmethod
    def built(cls, texts: list[list[bytes]]) -> Shard:
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(np.concatenate(([0], lengths + 1)))
        ends = starts[1:] - 1
        n = int(starts[-1])
        symbols = np.empty(n, np.int64)
        inner = np.ones(n, bool)
        inner[ends] = False
        symbols[inner] = np.fromiter((known[w] for words in texts for w in words), np.int64, n - len(texts))
        symbols[inner] += len(texts)
        symbols[ends] = np.arange(len(texts))
        order = sorted_suffixes(symbols)
        one = np.where(inner, symbols - len(texts) + 1, 0)  # all end marks are symbol 0 from here on
        counts = np.bincount(one, minlength=len(known) + 1)
        last = one[order - 1]
        levels = max(1, int(len(counts) - 1).bit_length())
        planes = np.zeros((levels, -(-(n + 1) // 64)), np.uint64)
        for level in range(levels):
            bit = (last >> (levels - 1 - level)) & 1
            planes[level] = _plane(bit, planes.shape[1])
            last = np.concatenate((last[bit == 0], last[bit == 1]))
        offset = np.arange(n) - np.repeat(starts[:-1], lengths + 1)
        keep = (offset % STEP == 0)[order]
        return cls(dict(known), starts, planes, counts, _plane(keep, planes.shape[1]), order[keep].astype(np.int32 if n < 2**31 else np.int64))

    def packed(self) -> dict[str, bytes]:
        return {"vocabulary": b" ".join(self.vocabulary), "starts": self.starts.astype("<i8").tobytes(), "planes": self.planes.tobytes(),
                "counts": self.counts.astype("<i4" if self.n < 2**31 else "<i8").tobytes(), "marks": self.marks.tobytes(),
                "kept": self.kept.astype("<i4" if self.n < 2**31 else "<i8").tobytes()}

    @classmethod
    def unpacked(cls, vocabulary: bytes, starts: bytes, planes: bytes, counts: bytes, marks: bytes, kept: bytes) -> Shard:
        words, borders, mark = vocabulary.split(), np.frombuffer(starts, "<i8"), np.frombuffer(marks, np.uint64)
        whole = "<i4" if borders[-1] < 2**31 else "<i8"
        return cls({w: i for i, w in enumerate(words)}, borders, np.frombuffer(planes, np.uint64).reshape(-1, len(mark)),
                   np.frombuffer(counts, whole).astype(np.int64), mark, np.frombuffer(kept, whole))

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place."""
        word = at >> 6
        under = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[level][word] + np.bitwise_count(self.planes[level][word] & under)

    def _before(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        levels = len(self.planes)
        for level in range(levels):
            one = self._rank(level, at)
            at = np.where((symbol >> (levels - 1 - level)) & 1, self.n - self.ones[level] + one, at - one)
        return at - self.base[symbol]

    def find(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase.

        A phrase is a row of word numbers of this shard, right-aligned; -1 is a word that the shard has not.
        """
        width = phrases.shape[1]
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        bad = ((phrases < 0) & (np.arange(width) >= width - sizes[:, None])).any(axis=1)
        high[bad] = 0
        for back in range(1, width + 1):
            live = np.flatnonzero((low < high) & (sizes >= back))
            if not len(live):
                break
            symbol = phrases[live, width - back] + 1
            low[live] = self.before[symbol] + self._before(symbol, low[live])
            high[live] = self.before[symbol] + self._before(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of the suffix of each row, found by stepping back to a kept one."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_, at = np.arange(len(rows)), rows.astype(np.int64)
        levels = len(self.planes)
        while len(open_):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.marks[word] >> bit) & np.uint64(1) == 1
            found = at[hit]
            inside = self.marks[found >> 6] & ((np.uint64(1) << (found & 63).astype(np.uint64)) - np.uint64(1))
            out[open_[hit]] = self.kept[self.mark_ranks[found >> 6] + np.bitwise_count(inside)] + steps[open_[hit]]
            open_, at = open_[~hit], at[~hit]
            steps[open_] += 1
            symbol = np.zeros(len(at), np.int64)
            for level in range(levels):
                one = self._rank(level, at)
                bit = ((self.planes[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
                symbol = symbol * 2 + bit
                at = np.where(bit == 1, self.n - self.ones[level] + one, at - one)
            at = self.before[symbol] + at - self.base[symbol]
        return out


def _plane(bits: np.ndarray, words: int) -> np.ndarray:
    packed = np.packbits(bits.astype(bool), bitorder="little")
    return np.concatenate((packed, np.zeros(words * 8 - len(packed), np.uint8))).view(np.uint64)
