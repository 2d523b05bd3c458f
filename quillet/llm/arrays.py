"""Suffix arrays of numbers and common prefixes, for texts of words."""

from __future__ import annotations

import numpy as np


def spread(sizes: np.ndarray) -> np.ndarray:
    """0..size-1 for each size, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _by_pairs(high: np.ndarray, low: np.ndarray, most: int) -> np.ndarray:
    """Places in the order of (high, low), numbers from 0 to ``most``; where three numbers fit in 63 bits, whole numbers with
    the place in their low bits are sorted, which is faster."""
    bits = int(most + 1).bit_length()
    if 3 * bits <= 63:
        return np.sort((high << (2 * bits)) | (low << bits) | np.arange(len(high))) & ((1 << bits) - 1)
    return np.argsort(high * (most + 1) + low)


def sort_suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes and their ranks, by Larsson and Sadakane's refinement: each round doubles the length that decides and
    sorts only the groups with several members, by the rank of what follows. The end of the text is less than any number."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = int(codes.max() + 1).bit_length()
    size = max(1, min(4, 62 // bits))
    padded = np.concatenate([codes + 1, np.zeros(size, np.int64)])
    head = padded[:n].copy()
    for k in range(1, size):
        head = (head << bits) | padded[k : k + n]
    order = np.argsort(head)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    places, opens = np.arange(n), np.ones(n, bool)
    opens[1:] = head[order[1:]] != head[order[:-1]]
    while True:
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(places)) - 1
        rank[order[places]] = np.repeat(places[last], last - first + 1)  # a group is named by its last place
        places = places[~(opens & np.append(opens[1:], True))]
        if not len(places):
            return order, rank[:n]
        suffix = order[places]
        group, follows = rank[suffix], rank[np.minimum(suffix + size, n)]
        again = _by_pairs(group, follows + 1, n)
        order[places] = suffix[again]
        group, follows = group[again], follows[again]
        opens = np.ones(len(places), bool)
        opens[1:] = (group[1:] != group[:-1]) | (follows[1:] != follows[:-1])
        size *= 2


def common_prefixes(codes: np.ndarray, order: np.ndarray, rank: np.ndarray) -> list[int]:
    """Of each sorted suffix and the one before, by Kasai's rule. The last number of ``codes`` must occur once in it."""
    text, before, places = codes.tolist(), order.tolist(), rank.tolist()
    common, h = [0] * len(text), 0
    for i, r in enumerate(places):
        if r:
            j = before[r - 1]
            while text[i + h] == text[j + h]:
                h += 1
            common[r] = h
            h = h - 1 if h else 0
        else:
            h = 0
    return common


def common_prefixes_of_pieces(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The same for a text of many short pieces, each with a last number that occurs once: they take Kasai's steps side by
    side."""
    common, shared = np.zeros(len(codes), np.int64), np.zeros(len(begin), np.int64)
    live, step = np.arange(len(begin)), 0
    while True:
        live = live[begin[live] + step < end[live]]
        if not len(live):
            return common
        at = begin[live] + step
        other = order[np.maximum(rank[at] - 1, 0)]
        h = np.maximum(shared[live] - 1, 0)
        first = rank[at] == 0
        h[first] = 0
        going = np.flatnonzero(~first)
        while len(going):
            going = going[codes[at[going] + h[going]] == codes[other[going] + h[going]]]
            h[going] += 1
        common[rank[at]] = shared[live] = h
        step += 1


class Minima:
    """The least of any stretch of numbers (under 2**31), from those of stretches of 2**k."""

    def __init__(self, values: np.ndarray) -> None:
        levels = [values.astype(np.int32)]
        while 2 ** len(levels) <= len(values):
            half, step = levels[-1], 2 ** (len(levels) - 1)
            levels.append(np.minimum(half[:-step], half[step:]))
        self.size, self.depth = len(values), len(levels)
        self.begin = np.concatenate([[0], np.cumsum([len(x) for x in levels])])[:-1]
        self.values = np.concatenate(levels)

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of low..high-1, never none."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        at = self.begin[level]
        return np.minimum(self.values[at + low], self.values[at + high - (1 << level)])

    def smaller_around(self, place: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last place before and the first after with less than ``value``; there must be such places."""
        low, high = place.copy(), place + 1
        for k in range(self.depth - 1, -1, -1):
            step, at = 1 << k, self.begin[k]
            down = low >= step
            down[down] = self.values[at + low[down] - step] >= value[down]
            low[down] -= step
            up = high + step <= self.size
            up[up] = self.values[at + high[up]] >= value[up]
            high[up] += step
        return low - 1, high
