"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance.

A document's fingerprint has a bit set where more than half of its shingles' hashes have it. Texts are lower-cased in
A-Z, words are runs of bytes other than 0x20 and 0x09-0x0D, shingles are ``shingle`` words joined by a space, repeats
included; fewer words make one shingle, none make fingerprint zero. The hash is XXH64 with seed 42; further lanes of 64
bits spread the same hash again.

Fingerprints within ``distance`` bits are linked; a component is named by its smallest doc_id. Equal fingerprints meet
first, so copies cost one row. Of the distinct fingerprints, those that agree in a block of bits are candidates:

* a block with two members gives its pair at once, from the aggregated (count, least, greatest);
* blocks up to ``SMALL`` members are joined and verified, at most ``SMALL / 2`` candidates a row;
* larger blocks are compared as numpy blocks whose links leave the task as a spanning forest: every link is seen, no list
  of pairs is built. A block of more than ``PIECE`` members comes apart by pigeonholes of its other bits first; what is
  as large still is dealt into pieces, and each pair of pieces is compared.

Components come from alternating large-star and small-star rounds over the links, each round cut by a checkpoint.

Defined results: a null text is empty; a null doc_id is the smallest id of all and shown as null; repeated rows share
one fingerprint and one component, each with its own result row; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import NULL_ID, durable, keyed, mix64, unkeyed, utf8

SMALL, PIECE = 8, 4096
#: Eight bytes of 0 or 1 for the eight bits of a byte, the highest bit first.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64)[:, 0]
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def majority(hashes: np.ndarray, lanes: int) -> bytes:
    """Big-endian bytes of the fingerprint: per bit, whether over half of the hashes have it."""
    out = []
    for lane in range(lanes):
        h = hashes if lane == 0 else mix64(hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        by = h.astype(">u8").view(np.uint8).reshape(-1, 8)
        total = np.zeros(64, np.int64)
        for k in range(0, len(by), 255):  # a byte counts up to 255
            total += _SPREAD[by[k : k + 255]].sum(0, dtype=np.uint64).view(np.uint8)
        out.append(np.packbits(total * 2 > len(hashes)).tobytes())
    return b"".join(out)


def fingerprint(text: bytes, shingle: int = 3, lanes: int = 1) -> bytes:
    words = text.lower().split()
    if not words:
        return bytes(8 * lanes)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), 42)]
    else:
        hashes = [digest(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))]
    return majority(np.array(hashes, np.uint64), lanes)


def fingerprints(docs: DataFrame, shingle: int = 3, lanes: int = 1) -> DataFrame:
    """doc_id (never null inside, see NULL_ID), fp binary. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = utf8(batch.column("text"))
            raw = buf.tobytes()
            fps = [fingerprint(raw[a:b], shingle, lanes) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return keyed(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, fp binary")


def block_tables(bits: int, blocks: int) -> list[np.ndarray]:
    """The bit places of each block table: all pairs of equal blocks."""
    parts = np.array_split(np.arange(bits), blocks)
    return [np.concatenate([parts[i], parts[j]]) for i in range(blocks) for j in range(i + 1, blocks)]


def _ints(fps: pd.Series, lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(fps), np.uint8).reshape(-1, 8 * lanes)


def _block_rows(distinct: DataFrame, places: list[np.ndarray], lanes: int) -> DataFrame:
    """key (table and block value), place (of the table), id: one row per distinct fingerprint and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in range(0, whole.num_rows, 4096):
                batch = whole.slice(row, 4096)
                bits = np.unpackbits(_ints(batch.column("fp").to_pylist(), lanes), axis=1)
                ids = batch.column("id").to_numpy()
                for t, p in enumerate(places):
                    value = np.zeros(len(ids), np.uint64)
                    for b in p:
                        value = value << np.uint64(1) | bits[:, b]
                    key = mix64(value + np.uint64(t << 57))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(ids), t, np.int16)), pa.array(ids)], ["key", "place", "id"])

    return distinct.select("id", "fp").mapInArrow(run, "key long, place short, id long")


def _finer_rows(crowded: DataFrame, places: list[np.ndarray], lanes: int, distance: int) -> DataFrame:
    """key, id of the rows (key, place, id, fp) of large blocks, once more by pigeonholes: of ``distance + 1`` parts of the
    bits outside a block, two fingerprints within the distance agree in one, so a block comes apart by them."""
    parts = [np.array_split(np.setdiff1d(np.arange(64 * lanes), p), distance + 1) for p in places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in range(0, whole.num_rows, 4096):
                batch = whole.slice(row, 4096)
                bits = np.unpackbits(_ints(batch.column("fp").to_pylist(), lanes), axis=1)
                keys, place, ids = (batch.column(c).to_numpy() for c in ("key", "place", "id"))
                for t in np.unique(place):
                    mine = place == t
                    for k, part in enumerate(parts[t]):
                        value = np.packbits(bits[mine][:, part], axis=1)
                        value = np.concatenate([value, np.zeros((len(value), -value.shape[1] % 8), np.uint8)], 1).view(np.uint64)
                        finer = keys[mine].view(np.uint64) + np.uint64(k + 1)
                        for column in value.T:
                            finer = mix64(finer) ^ column
                        yield pa.RecordBatch.from_arrays([pa.array(mix64(finer).view(np.int64)), pa.array(ids[mine])], ["key", "id"])

    return crowded.select("key", "place", "id", "fp").mapInArrow(run, "key long, id long")


def _hamming(a: str, b: str, lanes: int) -> Column:
    """Set bits of the two binaries' difference, eight bytes at a time."""
    total = None
    for k in range(lanes):
        one, two = (F.conv(F.hex(F.substring(F.col(x), 8 * k + 1, 8)), 16, -10).cast("long") for x in (a, b))
        n = F.bit_count(one.bitwiseXOR(two))
        total = n if total is None else total + n
    return total


def _forest(ids: np.ndarray, fps: np.ndarray, other_ids: np.ndarray, other: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """The links between two pieces, less those that earlier ones make needless."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    found = []
    a, b = fps.copy().view(np.uint64), other.copy().view(np.uint64)
    for k in range(len(ids)):
        near = np.bitwise_count(b ^ a[k]).sum(1) <= distance
        for x in other_ids[near].tolist():
            r, s = root(int(ids[k])), root(x)
            if r != s:
                parent[s] = r
                found.append((int(ids[k]), x))
    return found


def links(distinct: DataFrame, places: list[np.ndarray], lanes: int, distance: int) -> DataFrame:
    """a, b: ids of distinct fingerprints within ``distance`` bits, enough of them to connect all that are linked."""
    rows = _block_rows(distinct, places, lanes)
    sized = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("n > 1")
    sized = durable(sized)
    twos = sized.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    more = durable(rows.join(sized.where("n > 2").select("key", "n"), "key"))
    some = more.where(F.col("n") <= SMALL).select("key", "id")
    pairs = some.withColumnRenamed("id", "a").join(some.withColumnRenamed("id", "b"), "key").where("a < b").select("a", "b")
    pairs = twos.unionByName(pairs).distinct()
    left = distinct.select(F.col("id").alias("a"), F.col("fp").alias("fa"))
    right = distinct.select(F.col("id").alias("b"), F.col("fp").alias("fb"))
    near = pairs.join(left, "a").join(right, "b").where(_hamming("fa", "fb", lanes) <= distance).select("a", "b")

    ids = distinct.select("id", "fp")
    finer = durable(_finer_rows(more.where(F.col("n") > PIECE).join(ids, "id"), places, lanes, distance))
    counts = finer.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = more.where((F.col("n") > SMALL) & (F.col("n") <= PIECE)).select("key", "id", "n").unionByName(finer.join(counts, "key"))
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    large = crowded.withColumn("pieces", pieces).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    dealt = large.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "key", "id", "mine", F.least("mine", "with").alias("p"), F.greatest("mine", "with").alias("q")
    )
    dealt = dealt.join(ids, "id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["mine"].to_numpy() == pdf["p"].iloc[0]
        ids, fps = pdf["id"].to_numpy(), _ints(pdf["fp"], lanes)
        rest = first if pdf["p"].iloc[0] == pdf["q"].iloc[0] else ~first
        return pd.DataFrame(_forest(ids[first], fps[first], ids[rest], fps[rest], distance), columns=["a", "b"]).astype("int64")

    dense = dealt.groupBy("key", "p", "q").applyInPandas(compare, "a long, b long")
    return near.unionByName(dense.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, root (the least id of its component) for every id on a link. Large-star and small-star until nothing moves."""
    edges = durable(edges.select("a", "b").where("a <> b").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = durable(small.where("a <> b").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).collect()[0]
        if now == state or now["n"] == 0:
            break
        state = now
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "id")


def near_duplicates(docs: DataFrame, shingle: int = 3, lanes: int = 1, distance: int = 2, blocks: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: one row per document row.

    The tables are all pairs of blocks, which finds every link up to ``blocks - 2`` bits.
    """
    if blocks - 2 < distance:
        raise ValueError("pairs of blocks find links of up to blocks - 2 bits")
    fps = durable(fingerprints(docs, shingle, lanes))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("id"))
    distinct = durable(distinct)
    found = components(links(distinct, block_tables(64 * lanes, blocks), lanes, distance))
    named = distinct.join(found, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    out = fps.join(named, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
    return unkeyed(unkeyed(out), "component_id")


def keep_first(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component of texts of that Jaccard similarity (see ``similar``): that of its smallest doc_id (of its
    repeats, the one with the smallest text hash). Rows are told apart by doc_id and text: only like texts of an id merge."""
    from quillet.llm import similar

    own = docs.columns
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id")
    inner = docs.select(key, F.xxhash64("text").alias("th"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    firsts = similar.firsts(inner.select("id", "th", "text"), shingle, similarity)
    held = inner.select("id", "th", "row").join(firsts, ["id", "th"], "left_semi")
    one = held.groupBy("id", "th").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select(*[F.col(f"row.`{c}`") for c in own])
