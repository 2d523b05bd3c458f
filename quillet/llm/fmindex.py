"""A compressed full-text index of pieces of words, and matching statistics of many streams at once.

The Burrows-Wheeler transform of the pieces lies in a wavelet tree, level by level, as packed bits with running counts. A
step of backward search is one look-up per level for either end of an interval of sorted suffixes. Every piece has an
owner; a match counts only if a piece of a smaller owner holds it, which the least owner of the interval tells.
"""

from __future__ import annotations

import numpy as np

from quillet.llm.arrays import Minima, common_prefixes_of_pieces, sort_suffixes, spread


class WaveletTree:
    """Ranks of symbols; symbols of one bit pattern so far lie together on each level, zeros first."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.depth = max(1, int(alphabet - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.depth - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.packbits(np.concatenate([bit, np.zeros(64 - len(bit) % 64, bit.dtype)]).astype(np.uint8), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))])[:-1].astype(np.int64))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        every = np.arange(alphabet)
        self.begin = self._descend(every, np.zeros(alphabet, np.int64))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k in range(self.depth):
            word, rest = place >> 6, (place & 63).astype(np.uint64)
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << rest) - np.uint64(1)))
            place = np.where((symbol >> (self.depth - 1 - k)) & 1, self.zeros[k] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._descend(symbol, place) - self.begin[symbol]


class FmIndex:
    """Over pieces of words, numbers from 0 to ``words`` - 1, one after another in ``text``; ``sizes`` parts them."""

    def __init__(self, text: np.ndarray, sizes: np.ndarray, words: int, owner: np.ndarray) -> None:
        count = len(sizes)
        ends = np.cumsum(sizes + 1) - 1
        codes = np.empty(len(text) + count, np.int64)
        codes[ends] = np.arange(count)  # each piece ends with a symbol of its own, less than all words
        codes[np.repeat(ends - sizes, sizes) + spread(sizes)] = text + count
        order, rank = sort_suffixes(codes)
        self.size = len(codes)
        self.common = Minima(np.append(common_prefixes_of_pieces(codes, ends - sizes, ends, order, rank), 0))
        last = codes[order - 1]
        self.tree = WaveletTree(np.where(last < count, 0, last - count + 1), words + 1)
        self.less = np.concatenate([[0], count + np.concatenate([[0], np.cumsum(np.bincount(text, minlength=words))[:-1]])]).astype(np.int64)
        self.owner = Minima(owner[np.searchsorted(ends, order, "left")])

    def matching_statistics(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, below: np.ndarray, least: int) -> np.ndarray:
        """By place of ``text``: how many words from there on some piece of an owner under ``below`` holds, for the streams
        begin..end-1. All streams go from their last word to their first side by side; a stream whose words left cannot make
        ``least`` any more stops, so lower figures are not all filled in."""
        found = np.zeros(len(text), np.int64)
        low, high = np.zeros(len(begin), np.int64), np.full(len(begin), self.size)
        length, place = np.zeros(len(begin), np.int64), end - 1
        live = np.arange(len(begin))
        while True:
            live = live[(place[live] - begin[live] + 1 + length[live] >= least) & (place[live] >= begin[live])]
            if not len(live):
                return found
            word = text[place[live]] + 1
            both = self.tree.rank(np.concatenate([word, word]), np.concatenate([low[live], high[live]]))
            a, b = self.less[word] + both[: len(live)], self.less[word] + both[len(live) :]
            some = a < b
            grows = some.copy()
            grows[some] = self.owner.least(a[some], b[some]) < below[live[some]]
            on = live[grows]
            low[on], high[on] = a[grows], b[grows]
            length[on] += 1
            found[place[on]] = length[on]
            place[on] -= 1
            stuck = live[~grows]
            place[stuck[length[stuck] == 0]] -= 1
            stuck = stuck[length[stuck] > 0]  # drop words at the right end: the parent interval
            x, y = (self.common.values[of[stuck]] for of in (low, high))
            node, depth = np.where(x >= y, low[stuck], high[stuck]), np.maximum(x, y)
            length[stuck] = depth
            inner = depth > 0
            low[stuck], high[stuck] = 0, self.size
            low[stuck[inner]], high[stuck[inner]] = self.common.smaller_around(node[inner], depth[inner])
