"""Periodic runs of words, by branching tandem repeats of a suffix tree (Stoye and Gusfield), and their collapse.

Per document, in the task that read it; nothing is shuffled:

1. A run of at least ``least`` words holds no word that is not inside a string of half as many words which the document
   has twice. Hashes of those strings show where runs can be at all; everything else is set aside. A hash that collides
   only lets more words through.
2. Those stretches of many documents are one text, parted by symbols that occur once. Its suffix tree is a suffix array
   (Larsson and Sadakane's refinement) with common prefixes, each neighbouring pair an inner node with two sides of
   leaves; a node of many children counts as a chain of such nodes with one depth.
3. Every node lists the leaves of its smaller side only, n log n in all. A leaf i of a node of depth q whose partner i+q
   or i-q lies on the other side starts, or ends, a tandem repeat of period q that branches after it.
4. A branching repeat is the last one of its run. Rotating it leftwards, word by word, finds the start; of several repeats
   with one end, multiples of a period inside the run of that period are the same run and go.

Defined results: a null text has no words; rows that repeat a doc_id are documents of their own; a null doc_id stays null
and its words are not rewritten; no rows give no rows; other columns are ignored. A task holds about a megabyte of texts,
or one longer text, at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.arrays import common_prefixes, sort_suffixes, spread
from quillet.llm.common import mix64

LEAST = 12
#: Leaves that are listed at once; characters of text that are taken together.
LEAVES, CHARS = 1 << 21, 1 << 20


def sides(common: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inner nodes (place between two leaves, low, high, depth): leaves low..place-1 and place..high are the two sides."""
    n, floor = len(common), 0
    low, high = np.zeros(n, np.int64), np.full(n, n - 1)
    stack: list[int] = []
    for k in range(1, n):
        depth = common[k]
        while stack and common[stack[-1]] >= depth:
            high[stack.pop()] = k - 1
        if depth:
            low[k] = stack[-1] if stack else floor
            stack.append(k)
        else:
            floor = k
    depths = np.array(common, np.int64)
    inner = np.flatnonzero(depths)
    return inner, low[inner], high[inner], depths[inner]


def branching_repeats(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all tandem repeats that branch: the words after the two copies differ."""
    order, rank = sort_suffixes(codes)
    inner, low, high, depth = sides(common_prefixes(codes, order, rank))
    left = inner - low <= high - inner + 1
    first, size = np.where(left, low, inner), np.where(left, inner - low, high - inner + 1)
    other_low, other_high = np.where(left, inner, low), np.where(left, high, inner - 1)
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    total = np.cumsum(size)
    at = 0
    while at < len(inner):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LEAVES, "right")))
        node = np.repeat(np.arange(at, end), size[at:end])
        leaf = order[first[node] + spread(size[at:end])]
        for step in (1, -1):
            partner = leaf + step * depth[node]
            inside = (partner >= 0) & (partner < len(codes))
            where = rank[np.where(inside, partner, 0)]
            found = inside & (where >= other_low[node]) & (where <= other_high[node])
            starts.append(np.minimum(leaf, partner)[found])
            periods.append(depth[node][found])
        at = end
    return np.concatenate(starts), np.concatenate(periods)


def rotations(codes: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How far each repeat can be rotated to the left. A symbol that occurs once comes before every stretch."""
    reach = np.zeros(len(start), np.int64)
    going, width = np.arange(len(start)), 16
    while len(going):
        place = np.maximum((start[going] - 1 - reach[going])[:, None] - np.arange(width), 0)
        unlike = codes[place] != codes[place + period[going][:, None]]
        ends = unlike.any(1)
        reach[going] += np.where(ends, unlike.argmax(1), width)
        going = going[~ends]
        width = min(2 * width, max(16, LEAVES // max(1, len(going))))
    return reach


def maximal_runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs that hold their smallest period twice. ``codes`` begins and ends with symbols
    that occur once, and so do all stretches in it."""
    start, period = branching_repeats(codes)
    end = start + 2 * period
    order = np.lexsort((period, end))
    start, period, end = start[order], period[order], end[order]
    out = [np.zeros((3, 0), np.int64)]
    while len(end):
        opens = np.ones(len(end), bool)
        opens[1:] = end[1:] != end[:-1]
        least = np.flatnonzero(opens)
        begin = start[least] - rotations(codes, start[least], period[least])
        out.append(np.stack([begin, end[least] - begin, period[least]]))
        group = np.cumsum(opens) - 1
        same = (period % period[least][group] == 0) & (start >= begin[group])
        start, period, end = start[~same], period[~same], end[~same]
    begin, length, period = np.concatenate(out, 1)
    return begin, length, period


def runs_of(lists: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """Of each list of words its runs of ``least`` words or more: rows (start, length, period) by start, then period."""
    none = np.zeros((0, 3), np.int64)
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for words in lists for w in words], np.int64)
    sizes = np.array([len(words) for words in lists], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    gram = (least + 1) // 2
    if len(codes) < least:
        return [none] * len(lists)
    # Strings of half the length that a document has twice.
    mixed = mix64(codes + 1)
    hashes = mix64(np.repeat(np.arange(len(lists)), sizes)[: len(codes) - gram + 1])
    for k in range(gram):
        hashes = (hashes ^ mixed[k : k + len(hashes)]) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    doc = np.repeat(np.arange(len(lists)), sizes)
    places = np.flatnonzero(doc[: len(hashes)] == doc[gram - 1 :])
    order = places[np.argsort(hashes[places])]
    twin = hashes[order[1:]] == hashes[order[:-1]]
    edge = np.zeros(len(codes) + 1, np.int64)
    places = np.concatenate([order[1:][twin], order[:-1][twin]])
    np.add.at(edge, places, 1)
    np.add.at(edge, places + gram, -1)
    held = np.cumsum(edge[:-1]) > 0
    opens = held & (np.concatenate([[True], ~held[:-1]]) | np.concatenate([[True], doc[1:] != doc[:-1]]))
    closes = held & (np.concatenate([~held[1:], [True]]) | np.concatenate([doc[1:] != doc[:-1], [True]]))
    low, high = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    low, high = low[high - low >= least], high[high - low >= least]
    if not len(low):
        return [none] * len(lists)
    # One text of all stretches; symbols that occur once stand before each and at the end.
    size = high - low
    stretch = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.empty(stretch[-1] + 1, np.int64)
    text[stretch] = np.arange(len(stretch))
    text[np.repeat(stretch[:-1] + 1, size) + spread(size)] = codes[np.repeat(low, size) + spread(size)] + len(stretch)
    start, length, period = maximal_runs(text)
    start, length, period = (x[length >= least] for x in (start, length, period))
    which = np.searchsorted(stretch, start, "right") - 1
    start = start - stretch[which] - 1 + low[which]
    of = doc[low[which]]
    order = np.lexsort((period, start, of))
    found = np.stack([start - begin[of], length, period], 1)[order]
    cuts = np.searchsorted(of[order], np.arange(len(lists) + 1))
    return [found[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [w for w, gone in zip(words, (np.cumsum(edge[:-1]) > 0).tolist(), strict=True) if not gone]


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of all documents, chosen by their id, go on with a piece of theirs again and again."""
    h, n = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def find_runs(docs: DataFrame, least: int = LEAST, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, in words, by start and period), collapsed: the words that no run holds
    after its first period, joined by one space. ``rewrite`` changes the words of a document before."""

    def batch_of(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        words = [t.split() for t in texts]  # bytes part at ASCII white space only
        if rewrite:
            words = [rewrite(i, w) for i, w in zip(ids, words, strict=True)]
        runs = runs_of(words, least)
        every = np.concatenate(runs)
        numbers = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], ["start", "length", "period"])
        cuts = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        kept = pa.array([b" ".join(collapse(w, r)) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
        columns = [pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), numbers), kept]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = t.as_buffer().to_pybytes() if t.is_valid else b""
                ids.append(i)
                texts.append(text)
                held += len(text)
                if held >= CHARS:
                    yield batch_of(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield batch_of(ids, texts)

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
