"""Substring dedup: each word inside a window of 50 words that also starts in a document with a smaller id goes.

Every window belongs to one anchor: of the hashes of all ``GRAM``-word strings inside, the first least one. Equal windows
have one anchor at one place, so only windows of one anchor need comparing; an anchor that one document has alone has no
repeated window. That choice loses nothing:

1. One scan finds the anchors with the words of the windows that belong to each, a piece. Anchors of one document go.
   Pieces that agree as a whole (128 bits of hashes) are a class, which its least document stands for.
2. Classes fetch their words and are dealt to shards by anchor, an anchor with more than ``PART`` classes to several.
3. A shard builds a compressed FM-index of its classes (a wavelet tree over their Burrows-Wheeler transform). Streams go
   backwards through it and find matching statistics: how many words from a place on a smaller document of the shard holds.
   A class's least document is one stream; its copies, which have that document before them, are another. Stretches of
   ``WINDOW`` words or more are reported as intervals.
4. Anchors that were dealt to several shards meet again: windows that no smaller document of the shard holds are sent as
   128-bit digests, of which the least document stays.
5. Intervals are merged per document and their words removed.

A word counts by a 64-bit hash of its bytes. No shard or row holds more than a bounded number of pieces; copies of a piece
meet as a class by aggregation, and get their intervals back by a join that can be split. What steps hand on is a table in
the shared folder, deleted after its last use.

Defined results: a null text has no words; rows that repeat a doc_id are one document for the others and have a result row
each; a null doc_id is the smallest id and shown as null; texts under ``WINDOW`` words stay whole; no rows give no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.arrays import spread
from quillet.llm.common import NULL_ID, durable, kept, mix64, range_hashes, slices, unkeyed, utf8, words
from quillet.llm.fmindex import FmIndex
from quillet.llm.suffixes import owners, stretches

WINDOW, GRAM = 50, 8
#: Anchors that a window can have; words of the longest piece.
PLACES = WINDOW - GRAM + 1
#: Classes that are indexed together, about, and those of one anchor in one part.
SHARD, PART = 2048, 512
#: Longer words are hashed by themselves: sums of powers are weak for long words of few letters.
LONG = 64
_CLASS = ["anchor", "about", "more"]


def word_hashes(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    starts, ends, row = words(buf, at)
    hashes = range_hashes(buf, starts, ends)
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(buf[starts[k] : ends[k]].tobytes())
    return hashes, row


def _held(docs: DataFrame) -> DataFrame:
    """id, th, body of every document; th tells rows of one id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("th"), F.coalesce(text, F.lit("")).cast("binary").alias("body"))


def anchor_rows(held: DataFrame) -> DataFrame:
    """anchor, about, more (hashes of the piece), id, th, start (first word), starts (windows): one row per anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch.column("id").to_numpy(), batch.column("th").to_numpy()
            for first, _, buf, at in slices(*utf8(batch.column("body"))):
                hashes, row = word_hashes(buf, at)
                if len(hashes) < WINDOW:
                    continue
                place = np.arange(len(hashes) - GRAM + 1)
                grams = range_hashes(hashes, place, place + GRAM)
                owner = owners(grams, PLACES)
                whole = np.flatnonzero(row[: len(owner)] == row[WINDOW - 1 :])  # no window crosses documents
                if not len(whole):
                    continue
                owner = owner[whole]
                opens = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(row[whole], prepend=-1) != 0))
                count = np.diff(opens, append=len(owner))
                low, anchor = whole[opens], owner[opens]
                shape = mix64(((anchor - low) * 4096 + count).astype(np.uint64))
                about = [range_hashes(each, low, low + count - 1 + WINDOW) ^ shape for each in (hashes, mix64(hashes + np.uint64(1)))]
                begin = np.searchsorted(row, row[low], "left")
                numbers = (grams[anchor].view(np.int64), *(x.view(np.int64) for x in about), ids[first + row[low]], ths[first + row[low]], (low - begin).astype(np.int32), count.astype(np.int16))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in numbers], [*_CLASS, "id", "th", "start", "starts"])

    return held.mapInArrow(run, "anchor long, about long, more long, id long, th long, start int, starts short")


def fetch(held: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes (id, th, start, starts, and what else they carry) with the hashes of their words."""
    rest = [c for c in classes.columns if c not in ("id", "th")]
    lists = classes.groupBy("id", "th").agg(F.collect_list(F.struct(*rest)).alias("all"))
    found = held.dropDuplicates(["id", "th"]).join(lists, ["id", "th"]).select("id", "th", "body", "all")
    schema = classes.select("id", "th", *rest).schema.add("words", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, buf, at in slices(*utf8(batch.column("body"))):
                hashes, row = word_hashes(buf, at)
                begin = np.searchsorted(row, np.arange(end - first), "left")
                lists = batch.column("all").slice(first, end - first)
                count = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                of = lists.flatten()
                columns = {c: of.field(c) for c in rest}
                low = np.repeat(begin, count) + columns["start"].to_numpy()
                size = columns["starts"].to_numpy().astype(np.int64) - 1 + WINDOW
                data = hashes[np.repeat(low, size) + spread(size)]
                offsets = np.concatenate([[0], np.cumsum(size * 8)]).astype(np.int32)
                held_words = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
                keys = [pa.array(np.repeat(batch.column(c).to_numpy()[first:end], count)) for c in ("id", "th")]
                yield pa.RecordBatch.from_arrays([*keys, *columns.values(), held_words], schema.fieldNames())

    return found.mapInArrow(run, schema)


#: What shards report. SPAN: words from..to of (id, th). COPIES: the same of the piece, for documents after id that have the
#: class (x, y, z). LEFT: the window with digest (x, y) at from..to of (id, th), which no smaller document of the shard has.
SPAN, COPIES, LEFT = 0, 1, 2
_FOUND = ["kind", "x", "y", "z", "id", "th", "from", "to"]


def _intervals(place: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of neighbouring places in one piece, as indexes."""
    opens = np.ones(len(place), bool)
    opens[1:] = (place[1:] != place[:-1] + 1) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(opens)
    return first, np.append(first[1:], len(place))[: len(first)] - 1


def search_shard(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Matching statistics of all classes of a shard in the index of those classes."""
    column = lambda c: rows.column(c).to_numpy()
    hashes = np.frombuffer(b"".join(rows.column("words").to_pylist()), np.uint64)
    size = column("starts").astype(np.int64) - 1 + WINDOW
    ids, th, start, several = column("id"), column("th"), column("start"), column("shards") > 1
    names = np.stack([column(c) for c in _CLASS])
    known, text = np.unique(hashes, return_inverse=True)
    documents, owner = np.unique(ids, return_inverse=True)
    index = FmIndex(text, size, len(known), owner)
    end = np.cumsum(size)
    piece = np.repeat(np.arange(len(size)), size)

    def report(kind: int, of: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        values = (np.full(len(of), kind, np.int32), x, y, z, ids[of], th[of], low.astype(np.int32), high.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], _FOUND)

    # The least document of each class against smaller ones: those of the least document of all find nothing.
    held = index.matching_statistics(text, end - size, end, owner, WINDOW) >= WINDOW
    place = np.flatnonzero(held)
    first, last = _intervals(place, piece[place])
    of = piece[place[first]]
    none = np.zeros(len(of), np.int64)
    offset = start[of] - (end - size)[of]
    yield report(SPAN, of, none, none, none, place[first] + offset, place[last] + offset + WINDOW)

    # Copies of a class against its least document and smaller ones.
    copied = np.flatnonzero(column("copies"))
    place = np.flatnonzero(index.matching_statistics(text, (end - size)[copied], end[copied], owner[copied] + 1, WINDOW) >= WINDOW)
    first, last = _intervals(place, piece[place])
    of = piece[place[first]]
    yield report(COPIES, of, *names[:, of], place[first] - (end - size)[of], place[last] - (end - size)[of] + WINDOW)

    # Windows of anchors that other shards have too.
    place = np.flatnonzero(~held & several[piece] & (np.arange(len(text)) + WINDOW <= end[piece]))
    if len(place):
        two = np.frombuffer(b"".join(xxhash.xxh3_128_digest(hashes[k : k + WINDOW].tobytes()) for k in place.tolist()), np.int64).reshape(-1, 2)
        of = piece[place]
        offset = start[of] - (end - size)[of]
        yield report(LEFT, of, two[:, 0], two[:, 1], np.zeros(len(of), np.int64), place + offset, place + offset + WINDOW)


def covered(held: DataFrame) -> DataFrame:
    """id, th, spans: the words, from and to, of windows that smaller documents have."""
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in stretches(batches, ["anchor", "part"], SHARD):
            yield from search_shard(rows)

    with ExitStack() as stack:
        keep = lambda df: stack.enter_context(kept(df))
        rows = anchor_rows(held)
        several = keep(rows.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor"))
        known = keep(rows.join(several, "anchor", "left_semi"))
        least = F.min(F.struct("id", "th", "start", "starts")).alias("least")
        classes = keep(known.groupBy(*_CLASS).agg(least, F.max("id").alias("hi")).select(*_CLASS, "least.*", (F.col("hi") > F.col("least.id")).alias("copies")))
        groups = keep(classes.groupBy("anchor").agg(F.ceil(F.count("*") / PART).cast("long").alias("shards")))
        dealt = classes.join(groups, "anchor").withColumn("part", F.pmod(F.xxhash64("about"), "shards"))
        near = fetch(held, dealt).repartition(parts, "anchor", "part").sortWithinPartitions("anchor", "part")
        found = keep(near.mapInArrow(search, "kind int, x long, y long, z long, id long, th long, from int, to int"))

        spans = found.where(F.col("kind") == SPAN).select("id", "th", "from", "to")
        copies = found.where(F.col("kind") == COPIES).select(*[F.col(a).alias(b) for a, b in zip("xyz", _CLASS, strict=True)], F.col("id").alias("first"), "from", "to")
        alike = known.join(copies, _CLASS).where("id > first").select("id", "th", (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to")).alias("to"))
        left = found.where(F.col("kind") == LEFT)
        again = keep(left.groupBy("x", "y").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("x", "y", "lo"))
        across = left.join(again, ["x", "y"]).where("id > lo").select("id", "th", "from", "to")
        every = spans.unionByName(alike).unionByName(across)
        return durable(every.groupBy("id", "th").agg(F.collect_set(F.struct("from", "to")).alias("spans")))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that remain, joined by one space)."""
    held = _held(docs)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, spans in zip(batch.column("body"), batch.column("spans").to_pylist(), strict=True):
                text = body.as_buffer().to_pybytes().split()  # bytes part at ASCII white space only
                if spans:
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, [x["from"] for x in spans], 1)
                    np.add.at(edge, [x["to"] for x in spans], -1)
                    stay = [w for w, gone in zip(text, (np.cumsum(edge[:-1]) > 0).tolist(), strict=True) if not gone]
                    out.append((len(text), len(text) - len(stay), b" ".join(stay)))
                else:
                    out.append((len(text), 0, b" ".join(text)))
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns[:2], columns[2].cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    joined = held.join(covered(held), ["id", "th"], "left").select("id", "body", "spans")
    return unkeyed(joined.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string"))
