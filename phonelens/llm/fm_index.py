"""A compressed FM-index over word sequences, in numpy.

The index holds the Burrows-Wheeler transform of a text of word numbers in a
wavelet matrix (one packed bit vector with block ranks per bit of the word
number) and finds the suffix interval of a pattern by backward search, one
word at a time, for many patterns in lockstep.

Suffixes are sorted by their first ``depth`` words only (``DEPTH`` at least).
Patterns are no longer, and the ends of a pattern's interval then fall between
suffixes that differ within that depth, so counting preceding words at them is
exact.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64


def suffix_order(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Positions sorted by their next ``depth`` words or more (prefix doubling)."""
    n = len(text)
    rank = text.astype(np.int64)
    step = 1
    while True:
        nxt = np.zeros(n, np.int64)
        if step < n:
            nxt[:-step] = rank[step:] + 1
        key = rank * np.int64(n + int(rank.max()) + 2) + nxt
        order = np.argsort(key, kind="stable")
        ahead = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ahead[1:] != ahead[:-1]])
        step *= 2
        if step >= depth or rank[order[-1]] == n - 1:
            return order


class WaveletMatrix:
    """rank(c, i): how often c occurs among the first i values."""

    def __init__(self, values: np.ndarray):
        self.levels = max(1, int(values.max()).bit_length())
        self.words, self.blocks, self.zeros = [], [], []
        n = len(values)
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bit
            word = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(word)
            self.blocks.append(np.r_[0, np.cumsum(np.bitwise_count(word), dtype=np.int64)])
            self.zeros.append(n - int(bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        word, inside = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << inside) - np.uint64(1)
        return self.blocks[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, c: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Where c's occurrences before points[k] end in the sorted bottom
        row of the matrix (differences of two such values count c)."""
        for k in range(self.levels):
            one = ((c >> (self.levels - 1 - k)) & 1).astype(bool)
            ones = self._ones(k, points)
            points = np.where(one, self.zeros[k] + ones, points - ones)
        return points


class FMIndex:
    """Over texts given as word numbers from 1 on; 0 ends each text.
    ``longest``: words of the longest pattern to be searched."""

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray, longest: int = DEPTH):
        ends = np.zeros(1, np.int64)
        self.text = np.concatenate([x for t in texts for x in (t, ends)])
        lengths = np.array([len(t) + 1 for t in texts])
        self.order = suffix_order(self.text, max(DEPTH, longest))
        # in suffix order, with a guard at the end
        self.owner_end = np.append(np.repeat(owners, lengths)[self.order], np.iinfo(np.int64).max)
        self.matrix = WaveletMatrix(self.text[self.order - 1])  # the word before each suffix
        symbols = np.arange(int(self.text.max()) + 1)
        # first suffix of each word, less the word's place in the bottom row
        self.shift = np.searchsorted(np.sort(self.text), symbols) - self.matrix.rank(symbols, np.zeros(len(symbols), np.int64))

    def back(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of c + pattern from those of the patterns."""
        ends = self.matrix.rank(np.concatenate([c, c]), np.concatenate([low, high]))
        shift = self.shift[c]
        return shift + ends[: len(c)], shift + ends[len(c):]

    def _distinct(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of patterns of one length are equal or apart: each is
        named by its first suffix, and reading each once is linear."""
        first, at, which = np.unique(low, return_index=True, return_inverse=True)
        cuts = np.stack([first, high[at]], 1)
        return cuts, which, np.minimum.reduceat(self.owner_end, cuts.ravel())[0::2]

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        _, which, least = self._distinct(low, high)
        return least[which]

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first position in the text of the least owner of each interval
        (in a run of repeats, the one with the most text to follow)."""
        cuts, which, least = self._distinct(low, high)
        at = np.array([self.order[a:b][self.owner_end[a:b] == m].min() for (a, b), m in zip(cuts.tolist(), least.tolist())],
                      np.int64)
        return at[which]


CHECK_DEPTHS = (4, 8, 12, 16, 20, 25, 30, 35, 40, 43, 46, 48)  # words after which a search asks for smaller owners


def earlier_spans(index: FMIndex, queries: list[np.ndarray], owners: np.ndarray, threshold: int,
                  own_inside: bool = True) -> list[list[tuple[int, int]]]:
    """Per query the word spans covered by windows of ``threshold`` words that
    also occur in an indexed text with a smaller owner.  ``own_inside``: the
    queries are themselves indexed, so one occurrence is no match.

    Windows go left to right.  A window is searched from its last word
    backwards; where the interval holds no text of a smaller owner, every
    window over that part fails at once and the search jumps past its start.
    A found window is followed forwards in the index's text for as long as
    the words agree, which reports the whole match."""
    spans: list[list[tuple[int, int]]] = [[] for _ in queries]
    if not queries:
        return spans
    words = np.concatenate(queries)
    begin = np.r_[0, np.cumsum([len(q) for q in queries])]
    at = begin[:-1].copy()                      # start of each query's next window
    last = begin[1:] - threshold                # of its last one
    alive = np.flatnonzero(at <= last)
    total, alone = len(index.text), int(own_inside)
    while len(alive):
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), total)
        left = np.full(len(alive), threshold)   # words of the window not matched yet
        going = np.arange(len(alive))
        for depth in range(1, threshold + 1):
            left[going] = threshold - depth
            c = words[at[alive[going]] + threshold - depth]
            a, b = index.back(c, low[going], high[going])
            low[going], high[going] = a, b
            on = b - a > alone
            going, a, b = going[on], a[on], b[on]
            if len(going) and (depth in CHECK_DEPTHS or depth == threshold):
                going = going[index.least_owner(a, b) < owners[alive[going]]]
            if not len(going):
                break
        jump = left + 1
        f = going                               # windows found whole
        if len(f):
            place = index.earliest(low[f], high[f])
            q = alive[f]
            more = np.zeros(len(f), np.int64)
            run = np.arange(len(f))
            while len(run):                      # follow the match forwards
                here, there = at[q[run]] + threshold + more[run], place[run] + threshold + more[run]
                inside = (here < begin[q[run] + 1]) & (there < total)
                same = np.zeros(len(run), bool)
                same[inside] = words[here[inside]] == index.text[there[inside]]
                run = run[same]
                more[run] += 1
            for k, i in enumerate(q.tolist()):
                s = int(at[i] - begin[i])
                spans[i].append((s, s + threshold + int(more[k])))
            jump[f] = more + 1
        at[alive] += jump
        alive = alive[at[alive] <= last[alive]]
    return spans
