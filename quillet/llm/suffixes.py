"""Suffix-array dedup: every byte inside a 200-byte string that also starts elsewhere goes.

Each string of ``LENGTH`` bytes belongs to one anchor: of the hashes of all ``GRAM``-byte strings inside, the first least
one. Equal strings have the same anchor at the same place, so only strings of one anchor need comparing, and an anchor
that occurs once has no repeated string. That choice loses nothing:

1. Anchors of every document with the range of strings that belong to each, one scan; anchors that occur once go.
   Occurrences whose ranges agree as a whole (128 bits of hashes) are one class, aggregated on the map side. A class with
   several occurrences is repeated as a whole.
2. The other classes of an anchor, one occurrence each, are cut in up to ``BLOCKS`` pieces by where strings start. All
   strings of a piece hold its core. Pieces with one core are a group; a piece that is alone in its group has no repeated
   string, and one that agrees as a whole with another (128 bits) is repeated as a whole. What is left fetches its bytes.
3. Groups are dealt to shards, one with more than ``SHARD_PIECES`` pieces to several. A shard sorts all suffixes of its
   pieces: a suffix array by Larsson-Sadakane refinement, common prefixes of neighbours by Kasai's rule. Suffixes that
   share 200 bytes and stand at the same place of a group are one string; if it occurs twice, it is repeated.
4. Groups that were dealt to several shards meet again: a shard sends one row per distinct string, a 128-bit digest and,
   if the shard has met the string once only, where; the sorted runs are merged, and each string is looked up by binary
   search.
5. Repeated strings become covered spans of documents, merged per document.

Equality is taken from bytes inside a shard and from 128 bits of hashes elsewhere: two unlike strings among 10^15 agree
with a probability of about 1e-9. No shard, merging task or row holds more than a bounded number of pieces; no task
gathers a group of copies. What steps hand on is a table in the shared folder, deleted after its last use.

Defined results: a null text is empty: zero bytes, nothing removed; texts shorter than ``LENGTH`` bytes stay whole; of rows
that repeat a doc_id each is a document of its own (its place among equal ids by text hash; exact repeats are copies, so
their strings are repeated); a null doc_id is the smallest id and shown as null; no rows give no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import NULL_ID, _power_tables, durable, kept, mix64, range_hashes, slices, unkeyed, utf8

LENGTH, GRAM = 200, 50
#: A string of an anchor starts at one of so many places, at the anchor itself last; they are cut in BLOCKS ranges.
PLACES, BLOCKS = LENGTH - GRAM + 1, 3
WIDTH = -(-PLACES // BLOCKS)
#: Pieces that a shard sorts at once, and strings that a merging task looks up at once, about.
SHARD_PIECES, MERGE_ROWS = 1024, 200_000


def prefix_sums(buf: np.ndarray, salt: int) -> np.ndarray:
    """Of the bytes, each as a 64-bit number of its own, times powers of an odd base."""
    up, _ = _power_tables(len(buf) + 1)
    each = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * salt))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(each[buf] * up[: len(buf)], out=total[1:])
    return total


def hash_ranges(total: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges of bytes that the prefix sums belong to: equal content, equal hash."""
    _, down = _power_tables(len(total))
    return mix64((total[high] - total[low]) * down[low])


def owners(hashes: np.ndarray, window: int) -> np.ndarray:
    """By window of ``window`` hashes in a row: the place of the first least one, as 32 bits of the hash tell."""
    n = len(hashes)
    if n < window:
        return np.zeros(0, np.int64)
    # Least of each window from prefix and suffix minima of blocks of ``window``; the place goes along in the low bits.
    full = -(-n // window) * window
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[: n - window + 1], ahead[window - 1 : n]) & np.uint64(2**32 - 1)).astype(np.int64)


def _order(high: np.ndarray, low: np.ndarray, most: int) -> np.ndarray:
    """Places in the order of (high, low), both from 0 to ``most``. Sorting whole numbers with the place in their low bits
    is several times faster than sorting places by a key; that needs three fields in 63 bits."""
    bits = int(most + 1).bit_length()
    if 3 * bits <= 63:
        packed = np.sort((high << (2 * bits)) | (low << bits) | np.arange(len(high)))
        return packed & ((1 << bits) - 1)
    return np.argsort(high * (most + 1) + low)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes and their ranks, by Larsson-Sadakane refinement.

    Suffixes start sorted by four bytes (the end of the text counting as less than any); each round doubles the length,
    re-sorting only those whose group still has several members, by the rank of what follows. Ranks name the last place
    of a group, as in the paper.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(4, np.int64)])
    head = np.zeros(n, np.int64)
    for k in range(4):
        head = head * 257 + padded[k : k + n]
    bits = int(n).bit_length()  # the head takes 33 bits
    order = np.sort((head << bits) | np.arange(n)) & ((1 << bits) - 1) if bits <= 30 else np.argsort(head)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1

    def number(places: np.ndarray, opens: np.ndarray) -> None:
        """Ranks of the suffixes at these sorted places, where ``opens`` marks the first of each group."""
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(places)) - 1
        rank[order[places]] = np.repeat(places[last], np.diff(np.append(first, len(places))))

    sorted_head = head[order]
    opens = np.ones(n, bool)
    opens[1:] = sorted_head[1:] != sorted_head[:-1]
    number(np.arange(n), opens)
    size = 4
    places = np.arange(n)
    while True:
        alone = opens & np.append(opens[1:], True)
        places = places[~alone]
        if len(places) == 0:
            break
        suffix = order[places]
        group = rank[suffix]
        follows = rank[np.minimum(suffix + size, n)]
        again = _order(group, follows + 1, n)
        order[places] = suffix[again]
        group, follows = group[again], follows[again]
        opens = np.ones(len(places), bool)
        opens[1:] = (group[1:] != group[:-1]) | (follows[1:] != follows[:-1])
        number(places, opens)
        size *= 2
    return order, rank[:n]


_BYTES = np.array([1 << (8 * k) for k in range(8)], np.uint64)


def kasai(text: np.ndarray, begin: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Common prefix, up to ``most``, of each sorted suffix with the one before.

    Kasai's rule: the next suffix in the text shares at least one byte less with its own predecessor. The pieces of the
    text (from ``begin``) take their steps side by side; a comparison goes eight bytes at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(most + 16, np.uint8)]).astype(np.uint64)
    word = np.zeros(n + most + 8, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | padded[k : k + len(word)]
    ends = np.append(begin[1:], n)
    common, shared = np.zeros(n, np.int64), np.zeros(len(begin), np.int64)
    live = np.arange(len(begin))
    for step in range(int((ends - begin).max()) if len(begin) else 0):
        live = live[begin[live] + step < ends[live]]
        at = begin[live] + step
        other = before[at]
        h = np.where(other >= 0, np.maximum(shared[live] - 1, 0), 0)
        limit = np.minimum(n - np.maximum(at, other), most)  # the padding is no text
        going = np.flatnonzero((other >= 0) & (h < limit))
        while len(going):
            differ = word[at[going] + h[going]] ^ word[other[going] + h[going]]
            h[going] += 8 - np.searchsorted(_BYTES, differ, "right")
            going = going[(differ == 0) & (h[going] < limit[going])]
        h = np.minimum(h, np.where(other >= 0, limit, 0))
        common[at] = h
        shared[live] = h
    return common[order]


def shard_strings(pieces: list[bytes], lead: np.ndarray, anchor: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, place, string, weight) of all LENGTH-byte strings of the pieces; equal strings at the same place about
    the same anchor have the same number in ``string``, numbered in sorted order, and weight is how often it occurs.

    ``lead``: bytes before the anchor in a piece; ``anchor``: number of its anchor; ``count``: occurrences of the piece.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    text = np.frombuffer(b"".join(pieces), np.uint8)
    order, _ = suffix_array(text)
    common = kasai(text, begin, order)
    cls = np.cumsum(common < LENGTH) - 1
    piece = np.searchsorted(begin, order, "right") - 1
    place = order - begin[piece]
    inside = place + LENGTH <= sizes[piece]
    cls, piece, place = cls[inside], piece[inside], place[inside]
    about = place - lead[piece]
    which = anchor[piece] * (2 * LENGTH) + about + LENGTH  # place about an anchor, as one number
    key = _order(cls, which, max(len(text), int(which.max(initial=0))))
    cls, piece, place, which = cls[key], piece[key], place[key], which[key]
    new = np.ones(len(cls), bool)
    new[1:] = (cls[1:] != cls[:-1]) | (which[1:] != which[:-1])
    string = np.cumsum(new) - 1
    weight = np.bincount(string, count[piece], minlength=int(string[-1]) + 1 if len(string) else 0).astype(np.int64)
    return piece, place, string, weight


def _starts(docs: DataFrame) -> DataFrame:
    """id, th, body of every document; th tells repeats of an id apart."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("th"), body.alias("body"))


_CLASS = ["anchor", "about", "more"]


def anchor_rows(held: DataFrame) -> DataFrame:
    """anchor, about and more (hashes of the range of strings), id, th, start (of the first string), starts (how many), lead
    (places from the first string to the anchor): one row per anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch.column("id").to_numpy(), batch.column("th").to_numpy()
            for first, _, buf, at in slices(*utf8(batch.column("body"))):
                if len(buf) < LENGTH:
                    continue
                start = np.arange(len(buf) - GRAM + 1)
                grams = hash_ranges(prefix_sums(buf, 0), start, start + GRAM)
                owner = owners(grams, PLACES)
                row = np.searchsorted(at, np.arange(len(owner)), "right") - 1
                whole = np.arange(len(owner)) + LENGTH <= at[row + 1]  # no string crosses documents
                owner, place, row = owner[whole], np.flatnonzero(whole), row[whole]
                opens = np.flatnonzero(np.diff(owner, prepend=-1))
                count = np.diff(opens, append=len(owner))
                low, row, anchor = place[opens], row[opens], owner[opens]
                shape = mix64(((anchor - low) * 4096 + count).astype(np.uint64))
                # One lane over bytes, one over the strings of GRAM bytes: what one sum of powers mixes up, the other does not.
                about = [hash_ranges(prefix_sums(buf, 1), low, low + count - 1 + LENGTH) ^ shape, range_hashes(grams, low, low + count + LENGTH - GRAM) ^ shape]
                numbers = (grams[anchor].view(np.int64), *(x.view(np.int64) for x in about), ids[first + row], ths[first + row])
                shorts = (count.astype(np.int16), (anchor - low).astype(np.int16))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*numbers, (low - at[row]).astype(np.int32), *shorts)], [*_CLASS, "id", "th", "start", "starts", "lead"])

    return held.mapInArrow(run, "anchor long, about long, more long, id long, th long, start int, starts short, lead short")


def piece_keys(held: DataFrame, classes: DataFrame) -> DataFrame:
    """The pieces of the classes (anchor, n, id, th, start, starts, lead): group (hash of anchor, block and core), a, b
    (digest of the whole piece and its place), n, id, th, start (of the piece in its document), size, skip (places of the
    block before it)."""
    names = ("anchor", "n", "start", "starts", "lead")
    lists = classes.groupBy("id", "th").agg(F.collect_list(F.struct(*names)).alias("all"))
    found = held.join(lists, ["id", "th"]).select("id", "th", "body", *[F.col(f"all.{c}").alias(c) for c in names])
    whole, core = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest

    def cut(body: bytes, anchor: int, n: int, start: int, starts: int, lead: int) -> Iterator[tuple]:
        at = start + lead  # of the anchor
        for block in range((PLACES - 1 - lead) // WIDTH, (PLACES - 1 - lead + starts - 1) // WIDTH + 1):
            first = at - (PLACES - 1) + block * WIDTH
            low, high = max(first, start), min(first + WIDTH, start + starts) - 1
            key = core(b"%d %d " % (anchor, block) + body[first + WIDTH - 1 : first + LENGTH])
            yield key - 2**63, whole(b"%d %d " % (key, low - first) + body[low : high + LENGTH]), n, low, high + LENGTH - low, low - first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                body = batch.column("body")[row].as_py()
                about = [batch.column(c)[row].values.to_pylist() for c in names]
                group, digests, *rest = zip(*(x for each in zip(*about, strict=True) for x in cut(body, *each)), strict=True)
                two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                same = [pa.repeat(batch.column(c)[row], len(group)) for c in ("id", "th")]
                numbers = [pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.int32(), pa.int16(), pa.int16()), strict=True)]
                columns = [pa.array(group, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), numbers[0], *same, *numbers[1:]]
                yield pa.RecordBatch.from_arrays(columns, ["group", "a", "b", "n", "id", "th", "start", "size", "skip"])

    return found.mapInArrow(run, "group long, a long, b long, n long, id long, th long, start int, size short, skip short")


def fetch(held: DataFrame, pieces: DataFrame) -> DataFrame:
    """The pieces (id, th, start, size, and what else they carry) with their bytes."""
    rest = [c for c in pieces.columns if c not in ("id", "th")]
    lists = pieces.groupBy("id", "th").agg(F.collect_list(F.struct(*rest)).alias("all"))
    found = held.join(lists, ["id", "th"]).select("id", "th", "body", F.inline("all"))
    return found.select("id", "th", *rest, F.substring("body", F.col("start") + 1, F.col("size").cast("int")).alias("bytes"))


def stretches(batches: Iterator[pa.RecordBatch], names: list[str], most: int) -> Iterator[pa.Table]:
    """Whole groups of rows that agree in ``names``, of sorted batches: about ``most`` rows at a time."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rest = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
        opens = np.flatnonzero(np.any([np.diff(rest.column(n).to_numpy()) != 0 for n in names], axis=0)) + 1
        at = 0
        while (k := int(np.searchsorted(opens, at + most))) < len(opens):
            yield rest.slice(at, int(opens[k]) - at)
            at = int(opens[k])
        rest = rest.slice(at)
    if rest is not None and rest.num_rows:
        yield rest


_FOUND = "a long, b long, weight long, id long, th long, from int, to int"


def _found(a: np.ndarray, b: np.ndarray, weight: np.ndarray, of: pa.Table, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    doc = [of.column(c).to_numpy()[row] for c in ("id", "th")]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, weight, *doc, low.astype(np.int32), high.astype(np.int32))], ["a", "b", "weight", "id", "th", "from", "to"])


def sort_shard(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of one shard: the covered spans of what it can tell is repeated (weight 0); of groups that are dealt to several
    shards, a row per distinct string with its digest (weight 1: met once, and where; 2: met several times)."""
    column = lambda c: rows.column(c).to_numpy()
    key = np.stack([column(c) for c in ("group", "part")])
    group = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(0))])
    start, n, shards = column("start"), column("n"), column("shards")
    pieces = rows.column("bytes").to_pylist()
    piece, place, string, weight = shard_strings(pieces, -column("skip").astype(np.int64), group, n)
    order = np.lexsort((place, piece))
    piece, place, string = piece[order], place[order], string[order]
    once, twice = n[piece] == 1, weight[string] > 1
    # Neighbouring starts make one span.
    p, q = piece[once & twice], place[once & twice]
    opens = np.ones(len(p), bool)
    opens[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1] + 1)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(p))[: len(first)] - 1
    low = start[p[first]] + q[first]
    spread = mix64(low.astype(np.uint64) + column("th")[p[first]].view(np.uint64)).view(np.int64)
    yield _found(spread, np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), rows, p[first], low, start[p[last]] + q[last] + LENGTH)
    # Of strings that were met more than once (a repeated class counts as such), one stands for all.
    several = shards[piece] > 1
    shown = np.zeros(len(piece), bool)
    shown[np.unique(string, return_index=True)[1]] = True
    send = np.flatnonzero(several & shown)
    if len(send):
        p, q = piece[send], place[send]
        skip = column("skip")
        digest = [hashlib.blake2b(pieces[i][k : k + LENGTH], digest_size=16, key=b"%d %d" % (key[0, i], k + skip[i])).digest() for i, k in zip(p.tolist(), q.tolist(), strict=True)]
        two = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
        yield _found(two[:, 0], two[:, 1], np.minimum(weight[string[send]], 2), rows, p, start[p] + q, start[p] + q + LENGTH)


def merge_runs(rows: pa.Table) -> pa.Table:
    """Spans, and the strings (sorted by digest) whose weights over all runs make them repeated, found by binary search."""
    a, b, weight = (rows.column(c).to_numpy() for c in ("a", "b", "weight"))
    low, high = np.searchsorted(a, a, "left"), np.searchsorted(a, a, "right")
    total = np.concatenate([[0], np.cumsum(weight)])
    met = total[high] - total[low]
    for k in np.flatnonzero(b != b[low]):  # half of the digest agrees, the whole does not
        for j in range(low[k], high[k]):
            met[j] = weight[low[k] : high[k]][b[low[k] : high[k]] == b[j]].sum()
    return rows.filter(pa.array((weight == 0) | ((weight == 1) & (met > 1)))).select(["id", "th", "from", "to"]).combine_chunks()


def spans_of_pieces(pieces: DataFrame) -> DataFrame:
    """id, th, from, to: where the strings of the pieces (group, shards, n, id, th, start, skip, bytes) repeat."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("id", "th", "start"), "shards"))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in stretches(batches, ["group", "part"], SHARD_PIECES):
            yield from sort_shard(rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in stretches(batches, ["a"], MERGE_ROWS):
            yield from merge_runs(rows).to_batches()

    # Many small shards compress to little, which must not bring them together in a few tasks: hence the number of parts.
    found = dealt.repartition(parts, "group", "part").sortWithinPartitions("group", "part").mapInArrow(sort, _FOUND)
    runs = found.repartition(parts, "a").sortWithinPartitions("a", "b")
    return runs.mapInArrow(merge, "id long, th long, from int, to int")


def covered(held: DataFrame) -> DataFrame:
    """id, th, spans: where the texts of ``held`` (id, th, body) repeat, as (from, to) of bytes.

    Keys that are looked up are tables of their own, so that each join has its own exchange on both sides and adaptive
    execution can split a hot anchor or group.
    """
    one = lambda names: [F.first(c).alias(c) for c in names]  # noqa: E731 - of one row: the same merges choose them all
    end = lambda size: (F.col("start") + size).alias("to")
    with ExitStack() as stack:
        keep = lambda df: stack.enter_context(kept(df))
        rows = anchor_rows(held)
        several = keep(rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
        known = keep(rows.join(several, "anchor", "left_semi"))

        classes = known.groupBy(*_CLASS).agg(F.count("*").alias("n"), *one(("id", "th", "start", "starts", "lead")))
        unlike = keep(classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.min("n").alias("least")).where("classes > 1 AND least = 1").select("anchor"))
        keys = keep(piece_keys(held, classes.join(unlike, "anchor", "left_semi").drop("about", "more")))

        wholes = keys.groupBy("group", "a", "b").agg(F.sum("n").alias("n"), *one(("id", "th", "start", "size", "skip")))
        groups = wholes.groupBy("group").agg(F.count("*").alias("pieces"), F.min("n").alias("least")).where("pieces > 1 AND least = 1")
        groups = keep(groups.select("group", F.ceil(F.col("pieces") / SHARD_PIECES).cast("long").alias("shards")))
        pieces = keep(fetch(held, wholes.drop("a", "b").join(groups, "group")))

        same_class = keep(classes.where("n > 1").select(*_CLASS))
        same_piece = keep(wholes.where("n > 1").select("group", "a", "b"))
        alike = known.join(same_class, _CLASS, "left_semi").select("id", "th", F.col("start").alias("from"), end(F.col("starts") + LENGTH - 1))
        twice = keys.where("n = 1").join(same_piece, ["group", "a", "b"], "left_semi").select("id", "th", F.col("start").alias("from"), end(F.col("size")))
        spans = spans_of_pieces(pieces).unionByName(alike).unionByName(twice)
        return durable(spans.groupBy("id", "th").agg(F.collect_set(F.struct("from", "to")).alias("spans")))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that remain), kept_sha256."""
    held = _starts(docs)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, spans = batch.column("body"), batch.column("spans")
            out = []
            for k in range(batch.num_rows):
                text, runs = body[k].as_py(), []
                for low, high in sorted((x["from"], min(x["to"], len(text))) for x in spans[k].as_py() or ()):
                    if runs and low <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], high)
                    else:
                        runs.append([low, high])
                edges = [0, *(x for run in runs for x in run), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(runs), kept, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    joined = held.join(covered(held), ["id", "th"], "left").select("id", "body", "spans")
    return unkeyed(joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"))
